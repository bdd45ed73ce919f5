"""License scans: ordered signature rules behind keywords, with containment resolving overlaps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .text import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same over text in which A-Z are not yet lower case.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Signature:
    """A regular expression over lower-case text, tried where ``keyword`` occurs, which all its matches have in them.

    Priority 0 is the best.
    """

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


#: (label, keyword, name, identifier): names and identifiers are regular expressions over lower-case text.
LICENSES = [
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?", r"0bsd"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e,?(?: v(?:ersion|\.)? ?3(?:\.0)?)?", r"afl-3\.0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e,?(?: v(?:ersion|\.)? ?3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e,? v(?:ersion|\.)? ?1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[cs]e)?,? v?(?:ersion|\.)? ?2(?:\.0)?", r"apache-2\.0"),
    ("apsl-2.0", "apple", r"apple public source licen[cs]e,?(?: v(?:ersion|\.)? ?2(?:\.0)?)?", r"apsl-2\.0"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e,? v?(?:ersion|\.)? ?1(?:\.0)?", r"artistic-1\.0(?:-perl)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? v?(?:ersion|\.)? ?2(?:\.0)?", r"artistic-2\.0"),
    ("beerware", "beer", r"beer-?ware(?: licen[cs]e)?", r"beerware"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|2-clause bsd|two-clause bsd|bsd 2-clause)(?: licen[cs]e)?", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd|3-clause bsd|three-clause bsd|bsd 3-clause)(?: licen[cs]e)?", r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|4-clause bsd|four-clause bsd|bsd 4-clause)(?: licen[cs]e)?", r"bsd-4-clause"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e,?(?: -)?(?: v(?:ersion|\.)? ?1(?:\.0)?)?", r"bsl-1\.0"),
    ("busl-1.1", "business source", r"business source licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.1)?", r"busl-1\.1"),
    ("cc-by-1.0", "1.0", r"(?:cc[- ]by|creative commons attribution)[- ]?1\.0(?: [a-z]+)?(?: licen[cs]e)?", r"cc-by-1\.0"),
    ("cc-by-2.0", "2.0", r"(?:cc[- ]by|creative commons attribution)[- ]?2\.0(?: [a-z]+)?(?: licen[cs]e)?", r"cc-by-2\.0"),
    ("cc-by-2.5", "2.5", r"(?:cc[- ]by|creative commons attribution)[- ]?2\.5(?: [a-z]+)?(?: licen[cs]e)?", r"cc-by-2\.5"),
    ("cc-by-3.0", "3.0", r"(?:cc[- ]by|creative commons attribution)[- ]?3\.0(?: [a-z]+)?(?: licen[cs]e)?", r"cc-by-3\.0"),
    ("cc-by-4.0", "4.0", r"(?:cc[- ]by|creative commons attribution)[- ]?4\.0(?: [a-z]+)?(?: licen[cs]e)?", r"cc-by-4\.0"),
    ("cc-by-nc-3.0", "3.0", r"(?:cc[- ]by[- ]nc|attribution[- ]non-?commercial)[- ]?3\.0", r"cc-by-nc-3\.0"),
    ("cc-by-nc-4.0", "4.0", r"(?:cc[- ]by[- ]nc|attribution[- ]non-?commercial)[- ]?4\.0", r"cc-by-nc-4\.0"),
    ("cc-by-nc-nd-3.0", "3.0", r"(?:cc[- ]by[- ]nc[- ]nd|attribution[- ]non-?commercial[- ]no-?deriv[a-z]+)[- ]?3\.0", r"cc-by-nc-nd-3\.0"),
    ("cc-by-nc-nd-4.0", "4.0", r"(?:cc[- ]by[- ]nc[- ]nd|attribution[- ]non-?commercial[- ]no-?deriv[a-z]+)[- ]?4\.0", r"cc-by-nc-nd-4\.0"),
    ("cc-by-nc-sa-3.0", "3.0", r"(?:cc[- ]by[- ]nc[- ]sa|attribution[- ]non-?commercial[- ]share-?alike)[- ]?3\.0", r"cc-by-nc-sa-3\.0"),
    ("cc-by-nc-sa-4.0", "4.0", r"(?:cc[- ]by[- ]nc[- ]sa|attribution[- ]non-?commercial[- ]share-?alike)[- ]?4\.0", r"cc-by-nc-sa-4\.0"),
    ("cc-by-nd-3.0", "3.0", r"(?:cc[- ]by[- ]nd|attribution[- ]no-?deriv[a-z]+)[- ]?3\.0", r"cc-by-nd-3\.0"),
    ("cc-by-nd-4.0", "4.0", r"(?:cc[- ]by[- ]nd|attribution[- ]no-?deriv[a-z]+)[- ]?4\.0", r"cc-by-nd-4\.0"),
    ("cc-by-sa-2.5", "2.5", r"(?:cc[- ]by[- ]sa|attribution[- ]share-?alike)[- ]?2\.5", r"cc-by-sa-2\.5"),
    ("cc-by-sa-3.0", "3.0", r"(?:cc[- ]by[- ]sa|attribution[- ]share-?alike)[- ]?3\.0", r"cc-by-sa-3\.0"),
    ("cc-by-sa-4.0", "4.0", r"(?:cc[- ]by[- ]sa|attribution[- ]share-?alike)[- ]?4\.0", r"cc-by-sa-4\.0"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]?1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e,?(?: \(cddl\))?,?(?: v?(?:ersion|\.)? ?1\.0)?", r"cddl-1\.0"),
    ("cddl-1.1", "distribution", r"common development and distribution licen[cs]e,?(?: \(cddl\))?,? v?(?:ersion|\.)? ?1\.1", r"cddl-1\.1"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?,?(?: agreement)?(?: v?(?:ersion|\.)? ?2\.1)?", r"cecill-2\.1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.0)?", r"cpl-1\.0"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e,?(?: v?(?:ersion|\.)? ?2\.0)?", r"ecl-2\.0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e,?(?: v?(?:ersion|\.)? ?2(?:\.0)?)?", r"elastic-2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,?(?: -)? v?(?:ersion|\.)? ?1\.0", r"epl-1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,?(?: -)? v?(?:ersion|\.)? ?2\.0", r"epl-2\.0"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.2)?", r"eupl-1\.2"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.3)?", r"gfdl-1\.3(?:-only|-or-later)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,? v?(?:ersion|\.)? ?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? v?(?:ersion|\.)? ?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? v?(?:ersion|\.)? ?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", r"hpnd"),
    ("icu", "licen", r"icu licen[cs]e", r"icu"),
    ("ijg", "jpeg", r"independent jpeg group licen[cs]e", r"ijg"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.0)?", r"ipl-1\.0"),
    ("isc", "isc", r"\bisc licen[cs]e", r"isc"),
    ("lgpl-2.0", "public", r"(?:gnu )?library general public licen[cs]e,?(?: v?(?:ersion|\.)? ?2(?:\.0)?)?", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? v?(?:ersion|\.)? ?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? v?(?:ersion|\.)? ?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.3c?)?", r"lppl-1\.3c"),
    ("mit", "licen", r"\b(?:the )?(?:mit|expat) licen[cs]e", r"mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit-0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? v?(?:ersion|\.)? ?1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? v?(?:ersion|\.)? ?2\.0", r"mpl-2\.0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms-rl"),
    ("ncsa", "illinois", r"university of illinois/?(?:ncsa)? open source licen[cs]e", r"ncsa"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.0)?", r"odbl-1\.0"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.1)?", r"ofl-1\.1"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("osl-3.0", "open software", r"open software licen[cs]e,?(?: v?(?:ersion|\.)? ?3\.0)?", r"osl-3\.0"),
    ("php-3.01", "php", r"php licen[cs]e,?(?: v?(?:ersion|\.)? ?3\.01)?", r"php-3\.01"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e,?(?: v?(?:ersion|\.)? ?2)?", r"(?:psf-2\.0|python-2\.0)"),
    ("qpl-1.0", "q public", r"\bq public licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.0)?", r"qpl-1\.0"),
    ("ruby", "ruby", r"\bruby licen[cs]e", r"ruby"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e,?(?: v?(?:ersion|\.)? ?1)?", r"sspl-1\.0"),
    ("unlicense", "unlicen", r"\bthe unlicen[cs]e", r"unlicense"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e,?(?: v?(?:ersion|\.)? ?1\.0)?", r"upl-1\.0"),
    ("vim", "vim", r"\bvim licen[cs]e", r"vim"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? licen[cs]e", r"w3c"),
    ("wtfpl", "what the f", r"do what the f[a-z*]+ you want to public licen[cs]e", r"wtfpl"),
    ("x11", "x11", r"\bx11 licen[cs]e", r"x11"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[cs]e", r"zlib"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e,?(?: v?(?:ersion|\.)? ?2\.1)?", r"zpl-2\.1"),
]

#: (label, keyword, pattern, priority, weight) of addresses, wordings and unspecific mentions.
WORDINGS = [
    ("apache-2.0", "apache.org", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?", 0, 0.97),
    ("mit", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php)?", 0, 0.97),
    ("bsd-3-clause", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause", 0, 0.97),
    ("bsd-2-clause", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause", 0, 0.97),
    ("gpl-2.0", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.[a-z.]+)?", 0, 0.97),
    ("gpl-3.0", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.[a-z.]+)?", 0, 0.97),
    ("lgpl-2.1", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.[a-z.]+)?", 0, 0.97),
    ("agpl-3.0", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0(?:\.[a-z.]+)?", 0, 0.97),
    ("mpl-2.0", "mozilla.org", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0/?", 0, 0.97),
    ("epl-2.0", "eclipse.org", r"https?://(?:www\.)?eclipse\.org/legal/epl-2\.0/?", 0, 0.97),
    ("cc-by-4.0", "creativecommons", r"https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0/?", 0, 0.97),
    ("cc-by-sa-4.0", "creativecommons", r"https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0/?", 0, 0.97),
    ("cc-by-nc-4.0", "creativecommons", r"https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0/?", 0, 0.97),
    ("cc0-1.0", "creativecommons", r"https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?", 0, 0.97),
    ("unlicense", "unlicense.org", r"https?://(?:www\.)?unlicense\.org/?", 0, 0.97),
    ("mit", "permission is hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0, 0.99),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 0, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without\s+modification", 0, 0.95),
    ("gpl", "general public", r"redistribute it and/or modify\s+it under the terms of the gnu general public licen[cs]e", 0, 0.95),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 0, 0.95),
    ("gpl", "gpl", r"\bgpl(?:v[123])?\b", 2, 0.6),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", 2, 0.7),
    ("lgpl", "lgpl", r"\blgpl(?:v[23](?:\.1)?)?\b", 2, 0.6),
    ("lgpl", "lesser", r"lesser general public licen[cs]e", 2, 0.7),
    ("agpl", "agpl", r"\bagpl(?:v3)?\b", 2, 0.6),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", 2, 0.7),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[cs]e", 2, 0.7),
    ("mozilla", "mozilla", r"mozilla public licen[cs]e", 2, 0.7),
    ("eclipse", "eclipse", r"eclipse public licen[cs]e", 2, 0.7),
    ("artistic", "artistic", r"artistic licen[cs]e", 2, 0.7),
    ("creative-commons", "creative commons", r"creative commons(?: licen[cs]e)?", 2, 0.6),
    ("creative-commons", "cc", r"\bcc[- ]by(?:[- ](?:nc|nd|sa))*\b", 2, 0.6),
    ("public-domain", "public domain", r"public domain", 2, 0.5),
    ("proprietary", "proprietary", r"proprietary(?: and confidential)?(?: licen[cs]e)?", 2, 0.4),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 2, 0.5),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?\d{4}", 2, 0.4),
]


def signatures() -> list[Signature]:
    """All rules: for each license its name, its grant, its identifier and its tag, then the wordings."""
    out = []
    grant = r"(?:licen[cs]ed|released|distributed|published|available|provided) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"
    for label, keyword, name, identifier in LICENSES:
        out += [
            Signature(label, "spdx", rf"spdx-licen[cs]e-identifier: *\(?(?:[a-z0-9.+-]+ (?:or|and) )*{identifier}(?![a-z0-9.+-])", 0, 0.99),
            Signature(label, keyword, name + r"(?![a-z0-9])", 1, 0.9),
            Signature(label, keyword, grant + name + r"(?![a-z0-9])", 1, 0.95),
            Signature(label, "licen", rf"licen[cs]e[\"']? ?[:=] ?[\"']?{identifier}(?![a-z0-9.+-])", 1, 0.9),
        ]
    return out + [Signature(*w) for w in WORDINGS]


#: A text without any of these has no detection.
GATE = "(?i)" + "|".join(re.escape(k) for k in sorted({"license"} | {s.keyword for s in signatures()}))


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _rules(rules: list[Signature]) -> str:
    return "array(" + ", ".join(
        f"named_struct('label', '{r.label}', 'keyword', '{r.keyword}', 'pattern', {_quoted(r.pattern)}, "
        f"'priority', {r.priority}, 'weight', {r.weight}D)" for r in rules) + ")"


#: Where a phrase of the base starts: (place, label), in the words w.
_PLACES = """
    filter(transform(sequence(0, greatest(size(w) - 1, 0)), i -> named_struct('at', i, 'label', CASE
        WHEN get(w, i) = 'mit' AND get(w, i + 1) = 'license' THEN 'mit'
        WHEN get(w, i) = 'apache' AND get(w, i + 1) = 'license' THEN 'apache'
        WHEN get(w, i) = 'general' AND get(w, i + 1) = 'public' AND get(w, i + 2) = 'license' THEN 'gpl' END)),
        p -> p.label IS NOT NULL)"""

#: Detections of rule r in t, in the order that containment is judged in. ``parts`` lie between the ``hits``.
_SPANS = """
    aggregate(sequence(0, size(hits) - 1), named_struct('at', 0, 'found', cast(array() AS
        array<struct<first:int,last:int,priority:int,label:string,weight:double>>)),
        (acc, i) -> named_struct('at', acc.at + length(parts[i]) + length(hits[i]),
            'found', concat(acc.found, array(named_struct('first', acc.at + length(parts[i]),
                'last', -(acc.at + length(parts[i]) + length(hits[i])), 'priority', r.priority, 'label', r.label,
                'weight', r.weight)))), acc -> acc.found)"""

_NONE = "cast(array() AS array<struct<first:int,last:int,priority:int,label:string,weight:double>>)"


def scan_licenses(docs: DataFrame, rules: list[Signature] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    n_detections.

    The base counts the places where the words of a phrase stand consecutively. A rule is tried in every
    text that has its keyword. A detection is dropped if one of the same or a better priority contains it
    (of equal ones, the better priority, then the first label stays). labels are those of the base and of the detections that stay, distinct and
    sorted; score is the best weight of those, 0.6 for a base label alone, 0 without any. Null and empty texts have zero words,
    no labels and score 0. Rows are never brought together, so null and repeated ids stay as they are;
    other columns are not read.
    """
    rules = signatures() if rules is None else rules
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t0"))
    keywords = "array(" + ", ".join(_quoted(k) for k in sorted({r.keyword for r in rules})) + ")"
    lower = F.when(F.length("t0") == F.octet_length("t0"), F.lower("t0")).otherwise(lower_ascii(F.col("t0")))
    lowered = base.select(
        "doc_id", F.expr(f"size(regexp_extract_all(t0, r'{ANY_CASE_WORD}', 0))").cast("long").alias("n_words"), lower.alias("t"))
    places = f"transform(array(regexp_extract_all(t, r'{WORD}', 0)), w -> {_PLACES})[0]"
    per_rule = f"""transform(array(named_struct('parts', split(t, r.pattern, -1), 'hits', regexp_extract_all(t, r.pattern, 0))),
        x -> CASE WHEN size(x.hits) = 0 THEN {_NONE} ELSE {_SPANS.replace('parts', 'x.parts').replace('hits', 'x.hits')} END)[0]"""
    spans = f"array_sort(flatten(transform(filter({_rules(rules)}, r -> array_contains(held, r.keyword)), r -> {per_rule})))"
    kept = f"""aggregate({spans}, named_struct('e0', 0, 'e1', 0, 'e2', 0, 'labels', cast(array() AS array<string>),
        'weight', 0D, 'n', 0L), (acc, s) -> CASE
        WHEN greatest(acc.e0, CASE WHEN s.priority > 0 THEN acc.e1 ELSE 0 END, CASE WHEN s.priority > 1 THEN acc.e2 ELSE 0 END)
            >= -s.last THEN acc
        ELSE named_struct('e0', CASE WHEN s.priority = 0 THEN greatest(acc.e0, -s.last) ELSE acc.e0 END,
            'e1', CASE WHEN s.priority = 1 THEN greatest(acc.e1, -s.last) ELSE acc.e1 END,
            'e2', CASE WHEN s.priority = 2 THEN greatest(acc.e2, -s.last) ELSE acc.e2 END,
            'labels', array_union(acc.labels, array(s.label)), 'weight', greatest(acc.weight, s.weight), 'n', acc.n + 1) END)"""
    found = lowered.withColumn("base", F.expr(f"CASE WHEN contains(t, 'license') THEN {places} END")).withColumn(
        "kept", F.expr(f"transform(array(filter({keywords}, k -> contains(t, k))), held -> CASE WHEN size(held) > 0 THEN {kept} END)[0]")).drop("t")
    return found.select(
        "doc_id", "n_words",
        F.expr("CASE WHEN base IS NULL THEN 0L ELSE cast(size(base) AS BIGINT) END").alias("n_base"),
        F.expr("cast(array_min(base.at) AS BIGINT)").alias("first_word"), F.expr("cast(array_max(base.at) AS BIGINT)").alias("last_word"),
        F.expr("coalesce(array_join(array_sort(array_distinct(base.label)), ','), '')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(coalesce(base.label, cast(array() AS array<string>)), "
               "coalesce(kept.labels, cast(array() AS array<string>)))), ',')").alias("labels"),
        F.expr("greatest(coalesce(kept.weight, 0D), CASE WHEN size(base) > 0 THEN 0.6D ELSE 0D END)").alias("score"),
        F.expr("coalesce(kept.n, 0L)").alias("n_detections"))
