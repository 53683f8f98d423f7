"""Stems of Spanish words: a table of ending rules, applied to the distinct vocabulary only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = set("aeiou")
# Endings of nouns by the region that they must lie in, what replaces them and what may go before them; verb endings; residual vowels.
NOUN_RULES = (
    ("r2", "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "", ""),
    ("r2", "adora ador acion adoras adores aciones antes ancia ancias", "", "ic"),
    ("r2", "idad idades", "", "abil ic iv"),
    ("r2", "iva ivo ivas ivos", "", "at"),
    ("r1", "ucciones uccion", "uc", ""),
    ("r2", "logias logia", "log", ""),
    ("r2", "uciones ucion", "u", ""),
    ("r2", "encias encia", "ente", ""),
    ("r1", "mente", "", ""),
)
VERB_ENDINGS = (
    "ieron iendo iera ieras ieran ieses iesen iese ieseis aria arias arian ariais ariamos eria erias erian eriais eriamos iria irias irian iriais "
    "iriamos aban abas abais abamos aran aras arais aramos aren ares asen ases aseis asemos aron ando ados adas ados idos idas ada ado ida ido "
    "aba abas ara aras ase ases are ares aria ase ad ed id ar er ir amos iais eis eis en es is as os an"
)
RESIDUE = "os a o e"


def _longest_first(endings: str) -> list[str]:
    return sorted(set(endings.split()), key=lambda e: (-len(e), e))


_NOUNS = [(region, _longest_first(endings), into, before.split()) for region, endings, into, before in NOUN_RULES]
_VERBS, _RESIDUE = _longest_first(VERB_ENDINGS), RESIDUE.split()


def _after_vowel_pair(word: str, begin: int) -> int:
    """Behind the first consonant that follows a vowel."""
    return next((i + 2 for i in range(begin, len(word) - 1) if word[i] in VOWELS and word[i + 1] not in VOWELS), len(word))


def regions(word: str) -> dict[str, int]:
    """Where the regions r1, r2 and rv of a word begin."""
    r1 = _after_vowel_pair(word, 0)
    rv = len(word)
    if len(word) > 3:
        first, second = word[0] in VOWELS, word[1] in VOWELS
        if second and not first:
            rv = 3
        else:  # up to the next vowel behind a consonant, or the next consonant behind two vowels
            rv = next((i + 1 for i in range(2, len(word)) if (word[i] in VOWELS) != second), len(word))
    return {"r1": r1, "r2": _after_vowel_pair(word, r1), "rv": rv}


def _without(word: str, endings: list[str], begin: int) -> str | None:
    """word without the first of endings that lies in the region from begin on; None if none does."""
    return next((word[: -len(e)] for e in endings if word.endswith(e) and len(word) - len(e) >= begin), None)


def stem(word: str) -> str:
    """The stem of a folded word; words up to three letters, numbers and what would leave under three letters stay whole."""
    if len(word) <= 3 or word.isdigit():
        return word
    at = regions(word)
    for region, endings, into, before in _NOUNS:
        if (cut := _without(word, endings, at[region])) is not None:
            out = cut + into
            if before and (shorter := _without(out, before, at["r2"])) is not None:
                out = shorter
            break
    else:
        if (out := _without(word, _VERBS, at["rv"])) is not None:
            out = out[:-1] if out.endswith("gu") else out
        elif (out := _without(word, _RESIDUE, at["rv"])) is None:
            out = word
    return out if len(out) >= 3 else word


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_vocabulary(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms, so that each word is stemmed once and joined back."""
    return terms.select(F.col(column).alias("term")).where("term IS NOT NULL").distinct().withColumn("stem", stems("term"))


def stem_stages(word: str = "term") -> list[list[tuple[str, str]]]:
    """The rules as SQL: stages of (name, expression), each of which uses the names before it; the last gives stem."""
    behind = "length(regexp_extract({}, '^.*?[aeiou][^aeiou]', 0))"
    ending = lambda text, endings: f"regexp_extract({text}, '({'|'.join(endings)})$', 0)"
    cut = lambda name, text=word: f"substr({text}, 1, length({text}) - length({name}))"
    rv = f"length(regexp_extract({word}, '^.(?:[aeiou][aeiou]*[^aeiou]|[^aeiou][^aeiou]*[aeiou])', 0))"
    first = [("at1", f"CASE WHEN {behind.format(word)} > 0 THEN {behind.format(word)} ELSE length({word}) END"), ("atv", f"CASE WHEN length({word}) <= 3 THEN length({word}) WHEN regexp_extract({word}, '^[^aeiou][aeiou]', 0) != '' THEN 3 WHEN {rv} > 0 THEN {rv} ELSE length({word}) END")]
    rest = behind.format(f"substr({word}, at1 + 1)")
    second = [("at2", f"CASE WHEN {rest} > 0 THEN at1 + {rest} ELSE length({word}) END")]
    at = {"r1": "at1", "r2": "at2", "rv": "atv"}
    third = [(f"noun{k}", ending(f"substr({word}, {at[region]} + 1)", endings)) for k, (region, endings, _, _) in enumerate(_NOUNS)]
    third += [("verb", ending(f"substr({word}, atv + 1)", _VERBS)), ("vowel", ending(f"substr({word}, atv + 1)", _RESIDUE))]
    cases = []
    for k, (_, _, into, before) in enumerate(_NOUNS):
        out = f"{cut(f'noun{k}')} || '{into}'" if into else cut(f"noun{k}")
        if before:
            out = cut(ending(f"substr({out}, at2 + 1)", before), out)
        cases.append(f"WHEN noun{k} != '' THEN {out}")
    cases += [f"WHEN verb != '' THEN regexp_replace({cut('verb')}, 'gu$', 'g')", f"WHEN vowel != '' THEN {cut('vowel')}"]
    fourth = [("short", f"CASE {' '.join(cases)} ELSE {word} END")]
    whole = f"length({word}) <= 3 OR regexp_extract({word}, '^[0-9]+$', 0) != '' OR length(short) < 3"
    return [first, second, third, fourth, [("stem", f"CASE WHEN {whole} THEN {word} ELSE short END")]]


def with_stem(terms: DataFrame, word: str = "term") -> DataFrame:
    """terms with stem, by expressions of the JVM alone."""
    out = terms
    for stage in stem_stages(word):
        out = out.selectExpr("*", *[f"{e} AS {name}" for name, e in stage])
    return out.select(*terms.columns, "stem")
