"""Licence scanning by sentence rules.

Each known licence sentence has an identifier; a licence rule is an ordered
sequence of identifiers. A document's text is cut into sentences, these are
normalised and mapped to identifiers, and the document's identifier sequence
is matched against the rules. All of it is a projection of built-in functions
over a document's own row: no shuffle, no Python.

Sentences end at line breaks and at ``.``, ``!``, ``?`` or ``;`` before white
space or the end. Lines that together are a known sentence are one: a known
sentence may run over line breaks that neither sentence punctuation precedes
nor a blank line follows, also behind comment marks; lines with marks only are
blank. Normalising lower-cases, drops everything but letters and
digits, and replaces copyright years and holders by one form. Unknown
sentences between known ones don't break a rule as long as at most
``max_gap`` of them stand between two neighbours of the rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentence identifiers and the normalised sentences they stand for.
SENTENCES: dict[str, tuple[str, ...]] = {
    "cc-by-nc-4": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "cc-by-4": (
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    "cc-by-sa-4": (
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "spdx license identifier gpl 3 0 only",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "spdx license identifier apache 2 0",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "the mit license",
        "mit license",
        "spdx license identifier mit",
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "no-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "reserved": ("all rights reserved",),
    "copyright": ("copyright holder",),
}


@dataclass(frozen=True)
class LicenceRule:
    """``sequence``: identifiers in the order the text must have them."""

    licence: str
    sequence: tuple[str, ...]


RULES: tuple[LicenceRule, ...] = (
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    LicenceRule("CC-BY-4.0", ("cc-by-4",)),
    LicenceRule("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    LicenceRule("GPL-3.0", ("gpl-3",)),
    LicenceRule("Apache-2.0", ("apache-2",)),
    LicenceRule("MIT", ("mit",)),
    LicenceRule("MIT", ("mit-grant", "mit-notice")),
    LicenceRule("MIT", ("mit-grant", "no-warranty")),
    LicenceRule("BSD", ("bsd-grant",)),
    LicenceRule("all-rights-reserved", ("copyright", "reserved")),
    LicenceRule("all-rights-reserved", ("reserved",)),
)

SENTENCE_END = r"[\n\r]+|[.!?;]+[\x20\x09]+|[.!?;]+\z"
#: A line break inside a paragraph, with the marks that the next line starts with.
SOFT_BREAK = r"(?<![.!?;\n\r\x20\x09])[\x20\x09]*(?:\r\n|\n|\r)[^\p{L}\p{N}\n\r]*+(?=[^\n\r])"
#: What soft line breaks and sentence ends become.
SOFT, HARD = "\x01", "\x02"
COPYRIGHT = r"^(?:c )?copyright .*$"


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(sentence), COPYRIGHT, "copyright holder")


def marked(text: Column) -> Column:
    """The lower-cased words, with a mark at each soft line break and each sentence end."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), SOFT + HARD, "--")
    cut = F.regexp_replace(F.regexp_replace(plain, SOFT_BREAK, SOFT), SENTENCE_END, HARD)
    return F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{SOFT}{HARD}]+", " ")


def unwrapped(text: Column, forms: list[str]) -> Column:
    """``marked`` text without the soft line breaks inside known sentences, the longest first."""
    forms = sorted((f for f in forms if " " in f), key=lambda f: (-len(f), f))
    if not forms:
        return text
    words = {f: rf"[ {SOFT}]+".join(re.escape(w) for w in f.split(" ")) for f in forms}
    start, end = rf"(^|[{SOFT}{HARD}]) ?", rf"(?= ?(?:[{SOFT}{HARD}]|\z))"
    whole = text
    for f in forms:
        whole = F.regexp_replace(whole, f"{start}{words[f]}{end}", f"$1{f}")
    held = text.contains(SOFT) & text.rlike(f"{start}(?:{'|'.join(words.values())}){end}")
    return F.when(held, whole).otherwise(text)


def sentence_ids(text: Column, sentences: dict[str, tuple[str, ...]]) -> Column:
    """The text's sentences as (position, id); id is null for unknown ones. Blank ones don't count."""
    known = F.create_map(*[F.lit(x) for k, forms in sentences.items() for s in forms for x in (s, k)])
    whole = unwrapped(marked(text), [s for forms in sentences.values() for s in forms])
    parts = F.filter(F.transform(F.split(whole, f"[{SOFT}{HARD}]"), normalised), lambda s: s != "")
    return F.transform(parts, lambda s, i: F.struct(i.alias("position"), F.try_element_at(known, s).alias("id")))


def rule_pattern(rule: LicenceRule, number: dict[str, int], max_gap: int) -> str:
    """A regex over the identifier string ``<3><-><7>`` that the rule's sequence fits."""
    return rf"(?:<->){{0,{max_gap}}}".join(f"<{number[s]}>" for s in rule.sequence)


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, tuple[str, ...]] | None = None,
    rules: tuple[LicenceRule, ...] = RULES,
    max_gap: int = 2,
) -> DataFrame:
    """One row per document: ``id_col``, sentence_ids, positions, licences, n_sentences.

    sentence_ids lists the known sentences in the text's order, positions
    their places among all its sentences, licences the licences whose rules
    fit, in the rules' order and once each. Null and empty texts have empty
    lists. Repeated rows give repeated rows, an empty table none; other columns
    are not read.
    """
    sentences = SENTENCES if sentences is None else sentences
    number = {k: i for i, k in enumerate(sentences)}
    own = docs.select(F.col(id_col), sentence_ids(F.col(text_col), sentences).alias("all"))
    numbers = F.create_map(*[F.lit(x) for k, i in number.items() for x in (k, str(i))])
    trail = F.array_join(F.transform("all", lambda s: F.concat(F.lit("<"), F.coalesce(F.try_element_at(numbers, s["id"]), F.lit("-")), F.lit(">"))), "")
    own = own.withColumn("known", F.filter("all", lambda s: s["id"].isNotNull())).withColumn("trail", F.when(F.size("known") > 0, trail).otherwise(""))
    found = [F.when(F.col("trail").rlike(rule_pattern(r, number, max_gap)), F.lit(r.licence)) for r in rules]
    return own.select(
        id_col,
        F.col("known.id").alias("sentence_ids"),
        F.col("known.position").alias("positions"),
        F.array_distinct(F.array_compact(F.array(*found))).alias("licences"),
        F.size("all").alias("n_sentences"),
    )
