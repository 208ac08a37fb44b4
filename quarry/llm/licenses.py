"""License scans by sentence rules, in built-in functions only.

A text is cut into paragraphs at blank lines (comment marks alone are blank) and these, their lines joined,
into sentences at semicolons and full stops followed by white space; sentences are normalised (lower case,
runs of anything but letters, digits and a dot in a number become one space). Each pattern of a small fixed
table names a known licence sentence and, where it has one, a version. A sentence on one line that a pattern
of SENTENCES fits whole has that one identifier; any other has those of the PHRASES in it, in order, so that
wrapped notices are found and lines without a full stop aren't lost in one another. The ordered identifiers
of a document are then matched against ordered rules; each rule that matches consumes its identifiers, so
that a longer rule takes precedence over a shorter one. An SPDX line stands for the expression that it names;
"All rights reserved" in the header of a licence isn't a licence.

Only texts with a licence word are cut, so that most of them cost one scan. The SQL knows SENTENCES on single
lines alone; it agrees wherever no notice is wrapped, no PHRASES wording is met and none of the last two applies.

Defined cases: null and empty texts have no sentences and the licence NONE; sentences known but in no rule
give UNKNOWN; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence patterns (over normalised sentences, whole) and their identifiers, in order of trial.
SENTENCES = (
    (r"spdx license identifier ([a-z0-9. +]+)", "spdxId"),
    (r".*\blicensed under the apache license,? version 2\.0.*", "apache2Under"),
    (r".*\bapache license version 2\.0.*", "apache2Name"),
    (r".*\breleased under the mit license.*", "mitReleased"),
    (r".*\bpermission is hereby granted free of charge to any person obtaining a copy.*", "mitGrant"),
    (r".*\bthe above copyright notice and this permission notice shall be included.*", "mitNotice"),
    (r".*\bthe software is provided as is without warranty.*", "asIs"),
    (r".*\bgnu general public license,? version 3.*", "gpl3Under"),
    (r".*\bgnu general public license,? version 2.*", "gpl2Under"),
    (r".*\bgnu lesser general public license.*", "lgplUnder"),
    (r".*\blicensed under cc by nc 4\.0.*", "ccByNc4"),
    (r".*\blicensed under cc by sa 4\.0.*", "ccBySa4"),
    (r".*\blicensed under cc by 4\.0.*", "ccBy4"),
    (r".*\bredistribution and use in source and binary forms.*", "bsdRedistribution"),
    (r".*\bredistributions of source code must retain.*", "bsdSource"),
    (r".*\bredistributions in binary form must reproduce.*", "bsdBinary"),
    (r".*\bneither the name of .* may be used to endorse.*", "bsdEndorse"),
    (r".*\ball rights reserved.*", "allRights"),
    (r".*\bmozilla public license.*2\.0.*", "mpl2"),
    (r"(?:.*\b)?copyright (?:c )?\d{4}.*", "copyright"),
)
# Ordered rules (identifiers that follow one another) and the licences that they mean, longest first.
RULES = (
    (("bsdRedistribution", "bsdSource", "bsdBinary", "bsdEndorse"), "BSD-3-Clause"),
    (("bsdRedistribution", "bsdSource", "bsdBinary"), "BSD-2-Clause"),
    (("mitGrant", "mitNotice", "asIs"), "MIT"),
    (("mitGrant", "mitNotice"), "MIT"),
    (("spdxId",), "SPDX"),
    (("apache2Under",), "Apache-2.0"),
    (("apache2Name",), "Apache-2.0"),
    (("mitReleased",), "MIT"),
    (("gpl3Under",), "GPL-3.0"),
    (("gpl2Under",), "GPL-2.0"),
    (("lgplUnder",), "LGPL"),
    (("ccByNc4",), "CC-BY-NC-4.0"),
    (("ccBySa4",), "CC-BY-SA-4.0"),
    (("ccBy4",), "CC-BY-4.0"),
    (("mpl2",), "MPL-2.0"),
    (("allRights",), "Proprietary"),
)
HINT = r"(?i)licen[sc]e|copyright|rights reserved|permission|redistribution|provided as is|warranty|neither the name|\bCC BY\b"
LINES = "[\\n\\r;]"
ENDS = r"\.[ \t]+|\.$"


# Known phrases within a sentence, in order of trial at one place; without an identifier: mentions of other licences.
_GPL = r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)"
PHRASES = (
    (r"use the gnu (?:lesser|library) general public license instead", None),
    (r"secondary license means either the gnu general public license version 2\.0 the gnu lesser general public license", None),
    (r"spdx license identifier [a-z0-9. +]+", "spdxId"),
    (r"licensed under the apache license version 2\.0", "apache2Under"),
    (r"apache license version 2\.0", "apache2Name"),
    (r"(?:released|licensed|distributed|available) under the (?:terms of the )?(?:mit|expat) license", "mitReleased"),
    (r"permission is hereby granted free of charge to any person obtaining a copy", "mitGrant"),
    (r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included", "mitNotice"),
    (r"the software is provided as is without warranty", "asIs"),
    (_GPL + "3|under the terms of version 3 of the gnu general public license", "gpl3Under"),
    (_GPL + "2|under the terms of version 2 of the gnu general public license", "gpl2Under"),
    (r"gnu (?:lesser|library) general public license", "lgplUnder"),
    (r"licensed under cc by nc 4\.0", "ccByNc4"),
    (r"licensed under cc by sa 4\.0", "ccBySa4"),
    (r"licensed under cc by 4\.0", "ccBy4"),
    (r"redistribution and use in source and binary forms", "bsdRedistribution"),
    (r"redistributions of source code must retain", "bsdSource"),
    (r"redistributions in binary form must reproduce", "bsdBinary"),
    (r"neither the names? of .*? may be used to endorse|the names? of .*? may not be used to endorse", "bsdEndorse"),
    (r"all rights reserved", "allRights"),
    (r"mozilla public license(?: [a-z0-9.]+){0,4}? 2\.0", "mpl2"),
    (r"copyright (?:c )?\d{4}", "copyright"),
)
ANY = r"\b(?:" + "|".join(pattern for pattern, _ in PHRASES) + ")"
WORDS = r"(?i)licen[sc]e|copyright|reserved|permission|redistribution|warranty|endorse|\bCC BY\b"
BLANK = r"\n(?:[ \t]*[#*/;%!=-]*[ \t]*\n)+"
CUTS = r";(?!\s+either version)|(?<!\b(?:[Vv]|[Vv]er|[Vv]ers))\.\s+|\.$"  # not at the stop of "v. 2.0", nor within the header of the GPL
SPDX_LINE = r"(?im)^.*spdx-license-identifier:.*$"
_SPDX = r"\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*"
SPDX = rf"(?i)spdx-license-identifier:[ \t]*({_SPDX}(?:[ \t]+(?:and|or|with)[ \t]+{_SPDX})*)"
#: "All rights reserved" before a BSD licence, or between a copyright notice and any licence.
GRANTS = "|".join(sorted({rule[0] for rule, name in RULES} - {"allRights"}))
HEADERS = (("(?:,allRights)+(?=(?:,copyright|,allRights)*,bsdRedistribution,)", ""), (f",copyright,allRights(?=(?:,copyright)*,(?:{GRANTS}),)", ",copyright"))


def normalised(sentence: Column) -> Column:
    words = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    words = F.regexp_replace(words, r"\.+([^0-9.]|$)", " $1")  # dots stay within numbers alone
    return F.trim(F.regexp_replace(words, " +", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SENTENCES):
        out = F.when(F.regexp_like(sentence, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(out)
    return out


def identifiers(sentence: Column) -> Column:
    """The identifiers of a sentence (wrapped: has line ends, words: normalised), in order."""
    words, whole = sentence["words"], identifier(sentence["words"])
    name = lambda x: F.coalesce(*(F.when(F.regexp_like(x, F.lit(f"^(?:{pattern})$")), F.lit(name or "")) for pattern, name in PHRASES))
    inside = F.filter(F.transform(F.regexp_extract_all(words, F.lit(ANY), F.lit(0)), name), lambda x: x != "")
    return F.when(~sentence["wrapped"] & whole.isNotNull(), F.array(whole)).otherwise(inside)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences (known ones), sentence_ids (in order, joined by commas), licenses (in order of rules, joined)."""
    text = F.when(F.regexp_like(F.col(text_col), F.lit(WORDS)), F.regexp_replace(F.col(text_col), r"\r\n?", "\n")).otherwise(F.lit(""))
    known = lambda x: F.regexp_like(x, F.lit(WORDS))
    paragraphs = F.filter(F.split(F.regexp_replace(text, SPDX_LINE, "\n\n$0\n\n"), BLANK), known)
    sentences = F.filter(F.flatten(F.transform(paragraphs, lambda x: F.split(x, CUTS))), known)
    sentences = F.transform(sentences, lambda x: F.struct(F.contains(F.btrim(x, F.lit(" \t\n")), F.lit("\n")).alias("wrapped"), normalised(x).alias("words")))
    ids = F.flatten(F.transform(sentences, identifiers))
    spdx = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(x, r"\.+$", ""))
    found = docs.select(F.col(id_col), ids.alias("ids"), F.array_distinct(spdx).alias("spdx")).withColumn("sentence_ids", F.array_join("ids", ","))
    # A rule that matches takes its identifiers out, leaving a bar so that what it parted doesn't join up.
    left, names = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(",")), []
    for header, rest in HEADERS:
        left = F.regexp_replace(left, header, rest)
    for rule, name in RULES:
        sequence = "," + ",".join(rule) + ","
        named = F.when(F.size("spdx") > 0, F.col("spdx")).otherwise(F.array(F.lit(name))) if rule == ("spdxId",) else F.array(F.lit(name))
        names.append(F.when(F.contains(left, F.lit(sequence)), named).otherwise(F.array().cast("array<string>")))
        left = F.replace(left, F.lit(sequence), F.lit(",|,"))
    matched = F.array_distinct(F.flatten(F.array(*names)))
    verdict = F.when(F.size(matched) > 0, F.array_join(matched, ",")).when(F.size("ids") > 0, F.lit("UNKNOWN")).otherwise(F.lit("NONE"))
    return found.select(id_col, F.size("ids").alias("n_sentences"), "sentence_ids", verdict.alias("licenses"))
