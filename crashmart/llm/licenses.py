"""Licence recognition by sentence rules.

A text is cut into sentences over hard-wrapped lines, these are normalised (lower case, only letters, digits, dots, pluses and hyphens between single blanks), and
each is mapped to a known licence-sentence identifier. The identifiers of a text in order, with one mark wherever other sentences stand
between, are then matched against licence rules: identifier sequences, with any other sentences between, tried in order, longer ones before the
shorter ones they contain. A
matched sequence is taken out, so that what is left of it cannot match again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences, and the patterns of their normalised forms. The first that fits names the sentence.
SENTENCES = [
    ("SpdxTag", r"spdx-license-identifier"),
    ("MitGrant", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"^the above copyright notice and this permission notice shall be included"),
    ("IscGrant", r"^permission to use copy modify and.or distribute this software"),
    ("AsIs", r"^(the|this) (software|program|work|library) is (provided|distributed) .*as is"),
    ("BsdGrant", r"^redistribution and use in source and binary forms"),
    ("BsdSource", r"^(1. )?redistributions of source code must retain"),
    ("BsdBinary", r"^(2. )?redistributions in binary form must reproduce"),
    ("BsdNames", r"^(3. )?neither the name of"),
    ("ApacheTwo", r"licensed under the apache license.* version 2.0"),
    ("ApacheCopy", r"^you may obtain a copy of the license at"),
    ("ApacheLaw", r"^unless required by applicable law or agreed to in writing"),
    ("LgplThree", r"gnu lesser general public license.* version 3"),
    ("LgplTwo", r"gnu (lesser|library) general public license.* version 2"),
    ("AgplThree", r"gnu affero general public license.* version 3"),
    ("GplThree", r"gnu general public license.* version 3"),
    ("GplTwo", r"gnu general public license.* version 2"),
    ("GplNone", r"without any warranty without even the implied warranty"),
    ("GplCopy", r"^you should have received a copy of the gnu"),
    ("MplTwo", r"mozilla public license.* (v. )?2.0"),
    ("MitName", r"(released|licensed|distributed) under the (terms of the )?mit license"),
    ("BsdName", r"(released|licensed|distributed) under (the|a) .*bsd license"),
    ("CcZero", r"(cc0 1.0|creative commons zero)"),
    ("CcByNcNd", r"(cc by-nc-nd|attribution-noncommercial-noderiv)"),
    ("CcByNcSa", r"(cc by-nc-sa|attribution-noncommercial-sharealike)"),
    ("CcByNc", r"(cc by-nc|attribution-noncommercial)"),
    ("CcBySa", r"(cc by-sa|attribution-sharealike)"),
    ("CcBy", r"(licensed|released) under (a |the )?(cc by|creative commons attribution)"),
    ("PublicDomain", r"(dedicated to|released into|in) the public domain"),
    ("Copyright", r"^copyright (c )?[0-9]{4}"),
    ("Reserved", r"all rights reserved"),
]
# Licences, and the sentences that state them, in the order in which they are tried.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("ISC", ["IscGrant", "AsIs"]),
    ("Apache-2.0", ["ApacheTwo", "ApacheCopy", "ApacheLaw"]),
    ("GPL-3.0", ["GplThree", "GplNone", "GplCopy"]),
    ("GPL-2.0", ["GplTwo", "GplNone", "GplCopy"]),
    ("Apache-2.0", ["ApacheTwo"]),
    ("LGPL-3.0", ["LgplThree"]),
    ("LGPL-2.1", ["LgplTwo"]),
    ("AGPL-3.0", ["AgplThree"]),
    ("GPL-3.0", ["GplThree"]),
    ("GPL-2.0", ["GplTwo"]),
    ("MPL-2.0", ["MplTwo"]),
    ("MIT", ["MitName"]),
    ("BSD", ["BsdName"]),
    ("CC0-1.0", ["CcZero"]),
    ("CC-BY-NC-ND", ["CcByNcNd"]),
    ("CC-BY-NC-SA", ["CcByNcSa"]),
    ("CC-BY-NC", ["CcByNc"]),
    ("CC-BY-SA", ["CcBySa"]),
    ("CC-BY", ["CcBy"]),
    ("Public-Domain", ["PublicDomain"]),
    ("All-Rights-Reserved", ["Copyright", "Reserved"]),
]
HINTS = "licen|permission|copyright|redistribut|warrant|gnu|creative commons|cc0|cc by|public domain|neither the name|unless required|as is|rights reserved"
END = r"([.!?;:])\s+"


# What ends a sentence of a text on hard-wrapped lines. GAP is anything between two words, comment marks of a next line included.
GAP = r"[^a-zA-Z0-9]+"
OPENINGS = ["permission is hereby granted", "permission to use copy", "the above copyright notice and", "(?:the|this) (?:software|program|work|library) is (?:provided|distributed)",
            "redistribution and use", "redistributions (?:of|in)", "neither the name of", "you may obtain a copy", "unless required by applicable", "you should have received a copy", r"copyright (?:c )?[0-9]{4}"]
STOP = rf"[.](?<!\bv[.])\s+|[!?:]\s+|;(?!{GAP}without{GAP}even)\s+"
BLANK = r"\n[^a-zA-Z0-9\n]*\n"
OPENING = rf"\n(?=[^a-zA-Z0-9\n]*(?:{'|'.join(OPENINGS).replace(' ', GAP)}))"
CUT = f"(?i)(?:{STOP}|{BLANK}|{OPENING})"
# The number of a list item: at the start of a line or after a sentence, but not that of a version.
ITEM = r"((?:^|(?<!\b(?:version|v[.]))\n|[.](?<!\bv[.])\s|[!?;:]\s)[^a-zA-Z0-9(\n]*)\(?(?:[0-9]{1,3}|[a-zA-Z]|[ivxIVX]{2,4})[.)]\s+"
MARK = "\u0001"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9.+-]+", " "), "[.]+( |$)", " "))


def sentences(text: Column) -> Column:
    """Sentences of a text as they stand: they end at a sentence's end, a line without letters or digits, a list item or a known first line.

    Other line feeds are those of hard-wrapped lines and stay inside.
    """
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.split(F.regexp_replace(F.regexp_replace(lines, ITEM, f"$1{MARK}"), CUT, MARK), MARK, -1)


def identify(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or a hyphen."""
    known = F.lit("-")
    for name, pattern in reversed(SENTENCES):
        known = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(known)
    return F.when(sentence.rlike(HINTS), known).otherwise(F.lit("-"))


def identifiers(text: Column) -> Column:
    """The identifiers of a text's sentences in order, a hyphen for each other one; those without letters or digits are left out.

    A sentence over several lines has the identifier of the joined lines and those that single lines have, each once.
    """
    plain = F.transform(sentences(text), lambda s: F.struct(normal(s).alias("all"), F.when(F.instr(s, "\n") > 0, F.split(s, "\n", -1)).alias("lines")))
    plain = F.filter(plain, lambda s: s["all"] != "")
    lines = lambda s: F.when(s["all"].rlike(HINTS), F.filter(F.transform(s["lines"], lambda x: identify(normal(x))), lambda x: x != "-"))
    named = F.transform(plain, lambda s: F.struct(identify(s["all"]).alias("all"), F.coalesce(lines(s), F.array().cast("array<string>")).alias("lines")))
    return F.flatten(F.transform(named, lambda s: F.when((F.size(s["lines"]) > 0) & ((s["all"] == "-") | F.array_contains(s["lines"], s["all"])), F.array_distinct(s["lines"]))
                                 .otherwise(F.array_distinct(F.concat(F.array(s["all"]), s["lines"])))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences (identified ones), sentence_ids, licences: names in order of the rules, each once, joined by commas.

    sentence_ids joins the identifiers by blanks, a hyphen for each run of other sentences; it is empty without an identifier. A rule's
    identifiers may have other sentences between them. A null or empty text has none, and licences is then empty; null doc_ids and repeated
    rows keep rows of their own; other columns are ignored.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # A text without any hint word has no identifier: its sentences are not looked at.
    named = F.when(F.lower("text").rlike(HINTS.replace(" ", GAP)), identifiers(F.col("text"))).otherwise(F.array().cast("array<string>"))
    found = own.select("doc_id", named.alias("ids"))
    line = F.regexp_replace(F.array_join("ids", " "), "-( -)+", "-")
    known = F.size(F.filter("ids", lambda s: s != "-")).cast("long")
    found = found.select("doc_id", known.alias("n_sentences"), F.when(known > 0, line).otherwise(F.lit("")).alias("sentence_ids"))
    rest, hits = F.concat(F.lit(" "), "sentence_ids", F.lit(" ")), []
    for name, rule in RULES:
        wanted = f" {'(?: -)* '.join(rule)}(?= )"
        hits.append(F.when(rest.rlike(wanted), F.lit(name)))
        rest = F.regexp_replace(rest, wanted, " -")
    matched = F.when(F.col("n_sentences") > 0, F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",")).otherwise(F.lit(""))
    return found.select("doc_id", "n_sentences", "sentence_ids", matched.alias("licences"))


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    cases = " ".join(f"when regexp_matches(s, '{pattern}') then '{name}'" for name, pattern in SENTENCES)
    steps, rest = [], "r0"
    for i, (name, rule) in enumerate(RULES):
        wanted = f" {' '.join(rule)} "
        steps.append((f"case when contains({rest}, '{wanted}') then '{name}' end as h{i}", f"replace({rest}, '{wanted}', ' - ') as r{i + 1}"))
        rest = f"r{i + 1}"
    chain = "select *, ' ' || sentence_ids || ' ' as r0 from lines"
    for hit, left in steps:
        chain = f"select *, {hit}, {left} from ({chain})"
    hits = ", ".join(f"h{i}" for i in range(len(RULES)))
    return f"""
with cut as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{END}', '\\1' || chr(10), 'g'), chr(10)),
             lambda s: trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+-]+', ' ', 'g'), '[.]+( |$)', ' ', 'g'), ' ')), lambda s: s <> '') as parts from {table}),
ids as (select doc_id, list_transform(parts, lambda s: case when not regexp_matches(s, '{HINTS}') then '-' {cases} else '-' end) as ids from cut),
lines as (select doc_id, len(list_filter(ids, lambda s: s <> '-')) as n_sentences,
          case when len(list_filter(ids, lambda s: s <> '-')) = 0 then '' else regexp_replace(array_to_string(ids, ' '), '-( -)+', '-', 'g') end as sentence_ids from ids)
select doc_id, n_sentences, sentence_ids,
       case when n_sentences = 0 then '' else array_to_string(list_distinct_ordered, ',') end as licences
from (select *, list_filter([{hits}], lambda x, i: x is not null and not list_contains([{hits}][1:i-1], x)) as list_distinct_ordered from ({chain}))
"""
