"""Pieces of SQL that the oracle queries share; they spell out what the engine's functions compute."""

from __future__ import annotations

DEVA = "ऀ-ॿ"
MATRAS = "ािीुूृॄॅॆेैॉॊोौ"
MARKS = "ँंः"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n_of(c: str, characters: str) -> str:
    return f"length(regexp_replace({c}, {q('[^' + characters + ']+')}, '', 'g'))"


def visible(c: str) -> str:
    return f"length(regexp_replace({c}, '\\s+', '', 'g'))"


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0.0 END)"


def deva(c: str) -> str:
    return share(n_of(c, DEVA), visible(c))


def latin(c: str) -> str:
    return share(n_of(c, "A-Za-z"), visible(c))


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '\\S'))"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def transliterated(c: str, keys: dict[str, str]) -> str:
    """Longest keys first; needs no table."""
    import re

    long = sorted((k for k in keys if len(k) > 1), key=lambda k: (-len(k), k))
    pattern = "|".join([re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", k) for k in long] + ["(?s:.)"])
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in keys.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({c}, {q(pattern)}), lambda x: coalesce(({table})[x], x)), '')"


def date_code(c: str) -> str:
    s = strip(c)
    return f"({has(s, '^[@)!#$%&(*.+^=' + chr(92) + 's0-9]+$')} AND {has(s, '[@)!#$%&(*+^=]')})"


def plain_ascii(c: str) -> str:
    s = strip(c)
    return (
        f"(CASE WHEN {blank(c)} THEN true WHEN {date_code(c)} THEN false"
        f" WHEN contains({s}, 'www.') OR contains({s}, 'http://') OR contains({s}, 'https://') THEN true"
        f" WHEN {has(s, '^[0-9]+$')} THEN true WHEN {has(s, '@[A-Za-z]')} AND contains({s}, '.') THEN true"
        f" ELSE {has(s, '^[a-zA-Z0-9._:/' + chr(92) + '-' + chr(92) + 's]+$')} END)"
    )


def likely_preeti(c: str) -> str:
    letters = n_of(c, "A-Za-z")
    return f"(NOT {blank(c)} AND {letters} > 0 AND {n_of(c, chr(92) * 2 + ';lLfmosuv')} / {letters} > 0.20)"


def legacy_encoded(c: str) -> str:
    return (
        f"(CASE WHEN {blank(c)} OR {plain_ascii(c)} THEN false WHEN {deva(c)} >= 0.50 AND {latin(c)} < 0.15 THEN false"
        f" WHEN {date_code(c)} OR {likely_preeti(c)} THEN true ELSE {latin(c)} >= 0.08 OR {has(c, '[' + chr(92) + ']}/;{_|]')} END)"
    )


def penalty(c: str) -> str:
    only = f"regexp_replace({c}, '[^{DEVA}]+', '', 'g')"
    most = f"list_max(list_transform(list_distinct(string_split({only}, '')), lambda x: length({only}) - length(replace({only}, x, ''))))"
    dominant = f"(CASE WHEN length({only}) >= 5 THEN {most} / length({only}) ELSE 0.0 END)"
    symbols = "|=" + chr(92) + "[" + chr(92) + "]{}<>^~`" + chr(92) * 2
    return (
        f"(CASE WHEN {has(c, '(?i)undefined|nan|' + chr(92) + '[object')} THEN 40 ELSE 0 END + least(30, 2 * {n_of(c, symbols)}) + 8 * {count(c, '[' + DEVA + ']{22,}')}"
        f" + CASE WHEN {dominant} > 0.18 THEN 25 ELSE 0 END + CASE WHEN {latin(c)} > 0.20 AND {deva(c)} < 0.40 THEN 25 ELSE 0 END)"
    )


def score(c: str) -> str:
    return f"(CASE WHEN {blank(c)} THEN 0.0 ELSE greatest(0.0, 100.0 * {deva(c)} - {penalty(c)}) END)"


def once(c: str, marks: str = MATRAS + MARKS) -> str:
    for m in marks:
        c = f"regexp_replace({c}, '{m}+', '{m}', 'g')"
    return c


def without_orphans(c: str) -> str:
    allowed = f"'^[क-ह़{MATRAS}्]$'"
    return (
        f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN regexp_matches(substr({c}, i, 1), '^[{MATRAS}्]$')"
        f" AND (i = 1 OR NOT regexp_matches(substr({c}, i - 1, 1), {allowed})) THEN '' ELSE substr({c}, i, 1) END), '')"
    )


def redistributed(c: str) -> str:
    c = f"regexp_replace({c}, '([क-ह])([क-ह])ेा([क-ह])', '\\1े\\2ा\\3', 'g')"
    return f"regexp_replace({c}, '([क-ह])([क-ह])([ा-ौ])([ा-ौ])', '\\1\\3\\2\\4', 'g')"


def tidy_halants(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '्(\\s)', '\\1', 'g'), '्$', ''), '्{{2,}}', '्', 'g')"


def grammar_repaired(c: str, rounds: int = 5) -> str:
    for _ in range(rounds):
        c = f"regexp_replace(regexp_replace({c}, '^\\s?[ा-्]', ''), '\\s[ा-्]', ' ', 'g')"
        c = once(c, MATRAS)
        c = f"regexp_replace(regexp_replace({c}, '([ा-ौ])्', '\\1', 'g'), '्{{2,}}', '्', 'g')"
        c = f"regexp_replace(regexp_replace({c}, '्(\\s)', '\\1', 'g'), '्$', '')"
    return c
