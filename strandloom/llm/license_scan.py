"""Operator 9: licences by sentence rules, on DataFrame functions alone.

A text is cut into sentences, each is normalised (lower case, runs of other characters than letters and digits as one
space), and known licence sentences within it are mapped to their identifiers, in the order in which they occur. The
identifiers of a text form a sequence, and ordered licence rules, each a sequence of identifiers, are matched against it:
a rule that matches names its licence and takes its identifiers away, so that a longer rule goes before one that it
contains. Identifiers that no rule takes are reported as unmatched.

SPDX expressions are read as they stand, apart from the sentences: identifiers joined by AND, OR and WITH, also in
parentheses, up to the first word that can't go on; `-only` is dropped, `+` is `-or-later`.

A sentence that names a licence (`licensed under ...`) counts for nothing after `not`, `never`, `no part`, `nor` and the like
in the same sentence, unless a `but` stands between.

There is no shuffle or join: the tables of sentences and rules are literals of fixed size, and only texts with a cue word
are cut.

Defined results: every row gives a row, repeated rows too; a null, empty or licence-free text has empty strings and no
match; whole texts are read; other columns are ignored. A licence is named once however often it occurs, an identifier
counts once for each sentence; `NONE` and `NOASSERTION` are no SPDX expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Identifiers and normalised licence sentences; | is the beginning or end of a sentence.
SENTENCES = (
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is_software", "the software is provided as is without warranty of any kind"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd_endorse", "neither the name of"),
    ("bsd_warranty", "this software is provided by the copyright holders and contributors as is"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_notice", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_warranty", "the software is provided as is and the author disclaims all warranties"),
    ("apache2", "licensed under the apache license version 2 0"),
    ("apache2", "licenses this file to you under the apache license version 2 0"),
    ("apache2", "licensed under the apache license v 2 0"),
    ("apache2", "licensed under apache 2 0 |"),
    ("apache2", "| apache license version 2 0 |"),
    ("apache2", "| license apache 2 0 |"),
    ("or_apache2", "or the apache license version 2 0"),
    ("or_apache2", "or apache license version 2 0"),
    ("apache2_or_mit", "licensed under either of apache license version 2 0 or mit license"),
    ("apache2_use", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("apache2_basis", "distributed on an as is basis without warranties or conditions of any kind"),
    ("lgpl3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl21", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl3", "licensed under the gnu affero general public license version 3"),
    ("gpl3", "licensed under the gnu general public license version 3"),
    ("gpl2", "licensed under the gnu general public license version 2"),
    ("gpl_free", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl_free", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl2_free", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("agpl_free", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl_only2", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl_only3", "gnu general public license version 3 as published by the free software foundation"),
    ("lgpl_only21", "gnu lesser general public license version 2 1 as published by the free software foundation"),
    ("gpl_this2", "| version 2 of the license"),
    ("gpl_this2", "| version 2 |"),
    ("gpl_this3", "| version 3 of the license"),
    ("gpl_this3", "| version 3 |"),
    ("gpl_v2", "either version 2 of the license"),
    ("gpl_v21", "either version 2 1 of the license"),
    ("gpl_v3", "either version 3 of the license"),
    ("gpl_later", "or at your option any later version"),
    ("gpl_warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl_warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("bsl1_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib_warranty", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("epl2", "made available under the terms of the eclipse public license v 2 0"),
    ("epl2", "made available under the terms of the eclipse public license 2 0"),
    ("epl1", "made available under the terms of the eclipse public license v 1 0"),
    ("afl", "licensed under the academic free license version 3 0"),
    ("artistic2", "licensed under the artistic license 2 0"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("apache2", "licensed under the apache license 2 0"),
    ("apache2", "released under the apache license version 2 0"),
    ("bsd3", "licensed under the bsd 3 clause license"),
    ("bsd2", "licensed under the bsd 2 clause license"),
    ("isc", "licensed under the isc license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "available under the mit license"),
    ("mit", "licensed under mit |"),
    ("mit", "| mit license |"),
    ("mit", "| the mit license |"),
    ("mit", "| license mit |"),
    ("mit0", "licensed under the mit 0 license"),
    ("mit0", "| mit no attribution |"),
    ("bsd3", "| bsd 3 clause license |"),
    ("bsd3", "| license bsd 3 clause |"),
    ("bsd2", "| bsd 2 clause license |"),
    ("bsd2", "| license bsd 2 clause |"),
    ("isc", "| isc license |"),
    ("isc", "| license isc |"),
    ("bsd", "licensed under the bsd license"),
    ("mpl2", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl2", "licensed under the mozilla public license version 2 0"),
    ("cc_by_nc_nd", "licensed under cc by nc nd 4 0"),
    ("cc_by_nc_sa", "licensed under cc by nc sa 4 0"),
    ("cc_by_nc", "licensed under cc by nc 4 0"),
    ("cc_by_nd", "licensed under cc by nd 4 0"),
    ("cc_by_sa", "licensed under cc by sa 4 0"),
    ("cc_by", "licensed under cc by 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)

# Licences and the sequences of sentence identifiers that state them, in the order in which they are tried.
RULES = (
    ("MIT", "mit_grant mit_notice as_is_software"),
    ("MIT", "mit_grant mit_notice"),
    ("MIT-0", "mit_grant as_is_software"),
    ("BSD-4-Clause", "bsd_grant bsd_source bsd_binary bsd_advert bsd_endorse bsd_warranty"),
    ("BSD-4-Clause", "bsd_grant bsd_source bsd_binary bsd_advert bsd_endorse"),
    ("LicenseRef-BSD-advertising", "bsd_grant bsd_source bsd_binary bsd_advert"),
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_endorse bsd_warranty"),
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_endorse"),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary bsd_warranty"),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary"),
    ("ISC", "isc_grant isc_notice isc_warranty"),
    ("ISC", "isc_grant isc_notice"),
    ("0BSD", "isc_grant isc_warranty"),
    ("0BSD", "isc_grant"),
    ("BSL-1.0", "bsl1_grant"),
    ("Zlib", "zlib_warranty zlib_grant"),
    ("Zlib", "zlib_grant"),
    ("Apache-2.0", "apache2 apache2_use apache2_copy apache2_basis"),
    ("Apache-2.0", "apache2 apache2_use apache2_copy"),
    ("Apache-2.0", "apache2"),
    ("GPL-2.0", "gpl_free gpl_only2 gpl_warranty"),
    ("GPL-2.0", "gpl_free gpl_only2"),
    ("GPL-2.0", "gpl_free gpl_this2 gpl_warranty"),
    ("GPL-2.0", "gpl_free gpl_this2"),
    ("GPL-3.0", "gpl_free gpl_only3 gpl_warranty"),
    ("GPL-3.0", "gpl_free gpl_only3"),
    ("GPL-3.0", "gpl_free gpl_this3 gpl_warranty"),
    ("GPL-3.0", "gpl_free gpl_this3"),
    ("LGPL-2.1", "lgpl_free lgpl_only21 gpl_warranty"),
    ("LGPL-2.1", "lgpl_free lgpl_only21"),
    ("LGPL-2.0-or-later", "lgpl2_free gpl_v2 gpl_later gpl_warranty"),
    ("LGPL-2.0-or-later", "lgpl2_free gpl_v2 gpl_later"),
    ("GPL-3.0-or-later", "gpl_free gpl_v3 gpl_later gpl_warranty"),
    ("GPL-3.0-or-later", "gpl_free gpl_v3 gpl_later"),
    ("GPL-2.0-or-later", "gpl_free gpl_v2 gpl_later gpl_warranty"),
    ("GPL-2.0-or-later", "gpl_free gpl_v2 gpl_later"),
    ("LGPL-3.0-or-later", "lgpl_free gpl_v3 gpl_later gpl_warranty"),
    ("LGPL-3.0-or-later", "lgpl_free gpl_v3 gpl_later"),
    ("LGPL-2.1-or-later", "lgpl_free gpl_v21 gpl_later gpl_warranty"),
    ("LGPL-2.1-or-later", "lgpl_free gpl_v21 gpl_later"),
    ("AGPL-3.0-or-later", "agpl_free gpl_v3 gpl_later gpl_warranty"),
    ("AGPL-3.0-or-later", "agpl_free gpl_v3 gpl_later"),
    ("GPL-2.0-or-later", "gpl_free gpl_later gpl_warranty"),
    ("GPL-2.0-or-later", "gpl_free gpl_later"),
    ("GPL", "gpl_free gpl_warranty"),
    ("GPL", "gpl_free"),
    ("LGPL-3.0", "lgpl3"),
    ("LGPL-2.1", "lgpl21"),
    ("AGPL-3.0", "agpl3"),
    ("GPL-3.0", "gpl3"),
    ("GPL-2.0", "gpl2"),
    ("MIT OR Apache-2.0", "apache2_or_mit"),
    ("MIT OR Apache-2.0", "mit or_apache2"),
    ("MIT", "mit"),
    ("MIT-0", "mit0"),
    ("EPL-2.0", "epl2"),
    ("EPL-1.0", "epl1"),
    ("AFL-3.0", "afl"),
    ("Artistic-2.0", "artistic2"),
    ("WTFPL", "wtfpl"),
    ("BSD-3-Clause", "bsd3"),
    ("BSD-2-Clause", "bsd2"),
    ("ISC", "isc"),
    ("BSL-1.0", "boost"),
    ("BSD", "bsd"),
    ("MPL-2.0", "mpl2"),
    ("CC-BY-NC-ND-4.0", "cc_by_nc_nd"),
    ("CC-BY-NC-SA-4.0", "cc_by_nc_sa"),
    ("CC-BY-NC-4.0", "cc_by_nc"),
    ("CC-BY-ND-4.0", "cc_by_nd"),
    ("CC-BY-SA-4.0", "cc_by_sa"),
    ("CC-BY-4.0", "cc_by"),
    ("CC0-1.0", "cc0"),
    ("Unlicense", "unlicense"),
    ("all-rights-reserved", "reserved"),
)

# Words of which every licence sentence has one; a text without them is not cut.
CUES = ("licen", "permission", "copyright", "redistribut", "warrant", "neither", "public", "option", "reserved", "advertis", "version", "attribution")

# Words that begin a sentence which names a licence; what takes such a sentence back; what only looks so.
NAMING = ("licensed", "licenses", "released", "distributed", "dedicated", "made", "available", "subject", "you can redistribute", "or the apache", "or apache")
DENIALS = " (not|never|no part|nor|neither|none|isn t|aren t|wasn t|weren t|cannot|can t|no longer) "
HARMLESS = " not (only|part of|limited to) "

#: A full stop or colon that ends no sentence: of a version, of a name of a licence. Where sentences end.
UNCUT = r"(\b[vV]\.|\b[lL][iI][cC][eE][nN][sScC][eE]:)[ \t]*\n?[ \t]*(?:\*[ \t]*)?([A-Za-z0-9])"
ENDS = "(?<=[.!?;:])\\s+|\\n\\s*\\n"

#: An SPDX expression after its tag.
SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.:-]*\+?"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*{SPDX_ID}(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:\([ \t]*)*{SPDX_ID}(?:[ \t]*\))*)*)"
# How expressions are put in one form, one after the other: operators, spaces, stops at the end, versions.
SPDX_FORM = (
    (r"(?i)\s+and\s+", " AND "), (r"(?i)\s+or\s+", " OR "), (r"(?i)\s+with\s+", " WITH "), (r"[ \t]+", " "), (r"\([ \t]+", "("), (r"[ \t]+\)", ")"), (r"[.:-]+( |\)|$)", r"\1"), (r"\+( |\)|$)", r"-or-later\1"),
    (r"-only( |\)|$)", r"\1"), (r"^(?:NONE|NOASSERTION)$", ""),
)


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(low, F.lit(cue))
    return F.coalesce(found, F.lit(False))


def normalised(sentence: Column) -> Column:
    return F.concat(F.lit(" | "), F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), F.lit(" | "))


def table_of(pairs: tuple[tuple[str, str], ...], name: str, value: str, wrap: str) -> Column:
    return F.array(*[F.struct(F.lit(a).alias(name), F.lit(f"{wrap}{b}{wrap}").alias(value), F.lit(b.startswith(NAMING)).alias("names")) for a, b in pairs])


def expressions(text: Column) -> Column:
    """The SPDX expressions of a text, each in one form."""

    def form(x: Column) -> Column:
        for pattern, to in SPDX_FORM:
            x = F.regexp_replace(x, pattern, to.replace("\\1", "$1"))
        return F.btrim(x)

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), form), lambda x: x != "")


def denied(before: Column) -> Column:
    """Whether what stands before a sentence in its own takes it back."""
    return F.regexp_replace(F.regexp_replace(before, "^.* but ", " "), HARMLESS, " ").rlike(DENIALS)


def identifiers(text: Column, sentences: tuple[tuple[str, str], ...]) -> Column:
    """The identifiers of the licence sentences of a text, in order, as an array."""
    known = table_of(sentences, "id", "s", " ")

    def of(sentence: Column) -> Column:
        # A sentence may hold several; they are put in order of their place, then identifier.
        hits = F.filter(known, lambda k: F.contains(sentence, k["s"]) & ~(k["names"] & denied(F.substring(sentence, F.lit(1), F.position(k["s"], sentence)))))
        placed = F.transform(hits, lambda k: F.struct(F.position(k["s"], sentence).alias("at"), k["id"].alias("id")))
        return F.transform(F.sort_array(placed), lambda p: p["id"])

    plain = F.regexp_replace(F.regexp_replace(text, SPDX, "\n\n"), UNCUT, "$1$2")
    return F.flatten(F.transform(F.filter(F.transform(F.split(plain, ENDS), normalised), lambda s: F.length(s) > 5), of))


def matched(seq: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """A struct of the rest of the sequence and of the licences whose rules match, in the order of the rules."""
    start = F.struct(seq.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        table_of(tuple((a, f"|{b.replace(' ', '||')}|") for a, b in rules), "licence", "ids", ""),
        start,
        lambda acc, r: F.when(F.contains(acc["rest"], r["ids"]), F.struct(F.replace(acc["rest"], r["ids"], F.lit("")).alias("rest"), F.array_union(acc["found"], F.array(r["licence"])).alias("found"))).otherwise(acc),
    )


def license_report(docs: DataFrame, sentences=SENTENCES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the sentence identifiers, the licences of the matching rules and of SPDX expressions, the identifiers that
    no rule took, and the expressions."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.when(has_cue(F.col(text_col)), F.col(text_col)).alias("_t"))
    none = F.array().cast("array<string>")
    known = lambda found: F.when(F.col("_t").isNull(), none).otherwise(found)
    df = df.select("doc_id", known(identifiers(F.col("_t"), sentences)).alias("_ids"), known(F.array_distinct(expressions(F.col("_t")))).alias("_spdx"))
    df = df.withColumn("_seq", F.array_join(F.transform("_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))
    df = df.withColumn("_m", F.when(F.col("_seq") != "", matched(F.col("_seq"), rules)))
    text = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        "doc_id", F.size("_ids").cast("bigint").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join(F.array_union(F.coalesce("_m.found", none), "_spdx"), ",").alias("licences"),
        text(F.btrim(F.replace(F.col("_m.rest"), F.lit("||"), F.lit(",")), F.lit("|"))).alias("unmatched"), F.array_join("_spdx", ",").alias("spdx"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"{{'id': '{a}', 's': ' {b} ', 'names': {str(b.startswith(NAMING)).lower()}}}" for a, b in SENTENCES)
    form = "x"
    for pattern, to in SPDX_FORM:
        form = f"regexp_replace({form}, '{pattern}', '{to}', 'g')"
    steps, last = [], "r0"
    for k, (licence, ids) in enumerate(RULES, 1):
        ids = "|" + ids.replace(" ", "||") + "|"
        hit = f"contains(rest, '{ids}')"
        steps.append(f"r{k} AS (SELECT k, ids, CASE WHEN {hit} THEN replace(rest, '{ids}', '') ELSE rest END AS rest, CASE WHEN {hit} AND NOT list_contains(found, '{licence}') THEN list_append(found, '{licence}') ELSE found END AS found FROM {last})")
        last = f"r{k}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT k, list_filter(list_transform(regexp_extract_all(t, '{SPDX}', 1), lambda x: trim({form})), lambda x: x <> '') AS e FROM d),
p AS (SELECT k, regexp_replace(regexp_replace(t, '{SPDX}', chr(10) || chr(10), 'g'), '{UNCUT}', '\\1\\2', 'g') AS t FROM d),
s AS (SELECT k, u.n, ' | ' || trim(regexp_replace(lower(u.x), '[^a-z0-9]+', ' ', 'g')) || ' | ' AS s
      FROM (SELECT k, unnest(list_transform(string_split_regex(regexp_replace(t, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n\\s*\\n'), lambda x, i: {{'n': i, 'x': x}})) AS u FROM p)),
h AS (SELECT k, n, strpos(s, e.s) AS plc, e.id AS id FROM (SELECT k, n, s, unnest([{known}]) AS e FROM s)
      WHERE contains(s, e.s) AND NOT (e.names AND regexp_matches(regexp_replace(regexp_replace(substr(s, 1, strpos(s, e.s)), '^.* but ', ' '), '{HARMLESS}', ' ', 'g'), '{DENIALS}'))),
r0 AS (SELECT k, list(id ORDER BY n, plc, id) AS ids, string_agg('|' || id || '|', '' ORDER BY n, plc, id) AS rest, CAST([] AS VARCHAR[]) AS found FROM h GROUP BY k),
{", ".join(steps)}
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       array_to_string(list_concat(coalesce(found, []), list_filter(e, lambda v, i: list_position(e, v) = i AND NOT list_contains(coalesce(found, []), v))), ',') AS licences,
       coalesce(trim(replace(rest, '||', ','), '|'), '') AS unmatched, array_to_string(list_filter(e, lambda v, i: list_position(e, v) = i), ',') AS spdx
FROM d LEFT JOIN {last} USING (k) JOIN x USING (k)
"""


ORACLE_SQL = {"op9_license_scan": _oracle()}
