"""The stemmer's published steps as a chain of DuckDB statements over distinct words."""

from __future__ import annotations

from tunetable.functions.stemmer import IRREGULAR, MIN_STEMMED_LENGTH, STEP_2, STEP_3, STEP_4

VOWEL, CONSONANT = "[aeiouY]", "[^aeiouY]"


def shape(c: str) -> str:
    """Every ``y`` after a consonant as ``Y``; a match ends with the letter it changes."""
    return f"regexp_replace({c}, '({CONSONANT})y', '\\1Y', 'g')"


def measure(c: str) -> str:
    return f"len(regexp_extract_all({shape(c)}, '{VOWEL}+{CONSONANT}+'))"


def has_vowel(c: str) -> str:
    return f"regexp_matches({shape(c)}, '{VOWEL}')"


def short_end(c: str) -> str:
    return (
        f"(regexp_matches({shape(c)}, '^{VOWEL}{CONSONANT}$') or "
        f"regexp_matches({shape(c)}, '{CONSONANT}{VOWEL}[^aeiouYwxy]$'))"
    )


def cut(c: str, n: int) -> str:
    return f"substr({c}, 1, length({c}) - {n})"


def ends(c: str, suffix: str) -> str:
    return f"ends_with({c}, '{suffix}')"


def doubled(c: str) -> str:
    return (
        f"(length({c}) > 1 and substr({c}, -1) = substr({c}, -2, 1) "
        f"and regexp_matches({shape(c)}, '{CONSONANT}$'))"
    )


def replaced(rules: tuple[tuple[str, str], ...]) -> str:
    """The first matching suffix decides; it is replaced after a stem with a measure above 0."""
    cases = " ".join(
        f"when {ends('w', old)} then case when {measure(cut('w', len(old)))} > 0 "
        f"then concat({cut('w', len(old))}, '{new}') else w end"
        for old, new in rules
    )
    return f"case {cases} else w end"


def dropped() -> str:
    cases = []
    for suffix in STEP_4:
        stem = cut("w", len(suffix))
        allowed = f"{measure(stem)} > 1"
        if suffix == "ion":
            allowed += f" and right({stem}, 1) in ('s', 't')"
        cases.append(f"when {ends('w', suffix)} then case when {allowed} then {stem} else w end")
    return f"case {' '.join(cases)} else w end"


STEPS = (
    # plural
    f"""case when {ends("w", "sses")} then {cut("w", 2)}
      when {ends("w", "ies")} then case when length(w) = 4 then {cut("w", 1)} else {cut("w", 2)} end
      when {ends("w", "s")} and not {ends("w", "ss")} then {cut("w", 1)} else w end""",
    # past, with a mark where a suffix was cut off
    f"""case when {ends("w", "ied")} then case when length(w) = 4 then {cut("w", 1)} else {cut("w", 2)} end
      when {ends("w", "eed")} then case when {measure(cut("w", 3))} > 0 then {cut("w", 1)} else w end
      when {ends("w", "ed")} and {has_vowel(cut("w", 2))} then concat({cut("w", 2)}, '|')
      when {ends("w", "ing")} and {has_vowel(cut("w", 3))} then concat({cut("w", 3)}, '|') else w end""",
    f"""case when not {ends("w", "|")} then w
      when regexp_matches(w, '(at|bl|iz).$') then concat({cut("w", 1)}, 'e')
      when {doubled(cut("w", 1))} then case when regexp_matches(w, '[lsz].$') then {cut("w", 1)}
        else {cut("w", 2)} end
      when {measure(cut("w", 1))} = 1 and {short_end(cut("w", 1))} then concat({cut("w", 1)}, 'e')
      else {cut("w", 1)} end""",
    # final y
    f"""case when {ends("w", "y")} and length(w) > 2
      and regexp_matches({shape(cut("w", 1))}, '{CONSONANT}$') then concat({cut("w", 1)}, 'i') else w end""",
    # double suffixes
    f"case when {ends('w', 'alli')} and {measure(cut('w', 4))} > 0 then {cut('w', 2)} else w end",
    f"""case when {ends("w", "logi")} then case when {measure(cut("w", 3))} > 0 then {cut("w", 1)}
      else w end else {replaced(STEP_2)} end""",
    replaced(STEP_3),
    dropped(),
    # final e, double l
    f"""case when {ends("w", "e")} and ({measure(cut("w", 1))} > 1
      or ({measure(cut("w", 1))} = 1 and not {short_end(cut("w", 1))})) then {cut("w", 1)} else w end""",
    f"case when {ends('w', 'll')} and {measure(cut('w', 1))} > 1 then {cut('w', 1)} else w end",
)

_SPECIAL = " ".join(f"when '{word}' then '{stem}'" for word, stem in IRREGULAR.items())
_LAST = len(STEPS)


def stems(words: str) -> str:
    """CTEs ending in ``stems`` (word, stem) of the distinct words of a query with column ``word``."""
    chain = [f"step0 as materialized (select distinct word, word as w from ({words}) v)"]
    chain += [
        f"step{i + 1} as materialized (select word, {step} as w from step{i})"
        for i, step in enumerate(STEPS)
    ]
    chain.append(
        f"stems as materialized (select word, case when length(word) < {MIN_STEMMED_LENGTH} then word "
        f"else case word {_SPECIAL} else w end end as stem from step{_LAST})"
    )
    return ", ".join(chain)


def _stemmed(side: str) -> str:
    return f"""{side}_stems as (
  select model, sample_id, list(stem order by pos) as {side} from (
    select model, sample_id, unnest({side}) as word, unnest(range(len({side}))) as pos from plain) u
  join stems using (word) group by model, sample_id)"""


STEMMED_TOKENS = f"""plain as (
  select model, sample_id, regexp_extract_all(lower(prediction), '[a-z0-9]+') as p,
         regexp_extract_all(lower(reference), '[a-z0-9]+') as r from predictions),
{stems("select unnest(p) as word from plain union select unnest(r) from plain")},
{_stemmed("p")}, {_stemmed("r")},
toks as (
  select plain.model, plain.sample_id, coalesce(p_stems.p, []) as p, coalesce(r_stems.r, []) as r
  from plain left join p_stems using (model, sample_id) left join r_stems using (model, sample_id))"""
