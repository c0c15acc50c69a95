"""License scans by sentence rules (operator 8).

Texts are cut into sentences, each is normalised and looked up among the known license sentences, and the sequence of
identifiers found is matched against ordered rules: a rule that matches takes its identifiers away, so a
later, more general rule does not report them again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read_table

# Known license sentences, normalised (lower case, other characters than letters, digits and inner dots are
# one space, no dot at the end).
SENTENCES = {
    "apache2-by": "licensed under the apache license version 2.0",
    "apache2-1": "licensed under the apache license version 2.0 the license",
    "apache2-2": "you may not use this file except in compliance with the license",
    "apache2-3": "you may obtain a copy of the license at",
    "mit-by": "released under the mit license",
    "mit-by2": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-by": "this work is licensed under the gnu general public license version 3",
    "gpl-0": "this program is free software",
    "gpl-1": "you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2": "see the gnu general public license for more details",
    "bsd-1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met",
    "bsd-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission",
    "cc-by-nc4": "licensed under cc by nc 4.0",
    "cc-by-sa4": "licensed under cc by sa 4.0",
    "cc-by4": "licensed under cc by 4.0",
    "cc-by4-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "rights": "all rights reserved",
    "rights-2": "all rights reserved under copyright",
}
# Ordered rules, (license, sequence of sentences).
RULES = (
    ("Apache-2.0", ("apache2-1", "apache2-2", "apache2-3")),
    ("Apache-2.0", ("apache2-1", "apache2-2")),
    ("Apache-2.0", ("apache2-by",)),
    ("Apache-2.0", ("apache2-1",)),
    ("MIT", ("mit-title", "mit-1", "mit-2")),
    ("MIT", ("mit-1", "mit-2")),
    ("MIT", ("mit-1",)),
    ("MIT", ("mit-by",)),
    ("MIT", ("mit-by2",)),
    ("MIT", ("mit-title",)),
    ("GPL-3.0-or-later", ("gpl-0", "gpl-1", "gpl-2")),
    ("GPL-3.0-or-later", ("gpl-0", "gpl-1")),
    ("GPL-3.0-or-later", ("gpl-1",)),
    ("GPL-3.0-only", ("gpl3-by",)),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC-BY-4.0", ("cc-by4-long",)),
    ("proprietary", ("rights",)),
    ("proprietary", ("rights-2",)),
)
# Every known sentence holds one of these, so a text without them has no known sentence.
SIGNS = r"license|copyright|permission|permitted|redistributed|under\s+cc|free\s+software|reserved"
END = r"([.!?;:])\s+"
# Paragraphs end at blank lines, comment marks among them; inside one a line break may be a mere wrap.
PARAGRAPH = r"\n[ \t\r#*/;%-]*(?=\n)"
WRAP = r"\n[ \t#*/;%-]*"


def sentences(text: Column) -> Column:
    """Normalised sentences: cut at line breaks and after closing marks followed by white space; empty ones left out."""
    cut = F.split(F.regexp_replace(F.lower(text), END, "$1\n"), "\n")
    plain = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}.]+", " "), r"\.+( |$)", " "))
    return F.filter(F.transform(cut, plain), lambda s: s != "")


def recognise(docs: DataFrame, text_col: str = "text", known: dict = SENTENCES, rules=RULES, signs: str = SIGNS) -> DataFrame:
    """``docs`` with ``sentence_ids`` (known sentences in order, repeats included) and ``licenses`` (of the rules that match, in
    rule order, each once). Sentences are read line by line and over the wrapped lines of a paragraph.

    Null and empty texts have none. Texts are read whole; rows are independent (no shuffle), so repeated rows get equal
    results; an empty table gives no rows; other columns pass through (those named like the new ones are
    replaced). ``known`` and ``rules`` are literals of a few hundred entries at most; ``signs`` must occur in each
    known sentence.
    """
    by_text = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    listed = lambda t: F.filter(F.transform(sentences(t), lambda s: F.try_element_at(by_text, s)), lambda i: i.isNotNull())

    def both(paragraph):
        # a sentence may be a line or be wrapped over several: the reading with more known sentences, then what only the other has
        pair = F.struct(listed(paragraph).alias("lines"), listed(F.regexp_replace(paragraph, WRAP, " ")).alias("joined"))
        more = lambda x: F.size(x["joined"]) > F.size(x["lines"])
        return let(pair, lambda x: F.when(more(x), F.concat(x["joined"], F.array_except(x["lines"], x["joined"]))).otherwise(
            F.concat(x["lines"], F.array_except(x["joined"], x["lines"]))))

    found = F.flatten(F.transform(F.split(docs[text_col], PARAGRAPH), both))
    none = F.array().cast("array<string>")
    ids = F.when(F.lower(docs[text_col]).rlike(signs), found).otherwise(none)
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {'  '.join(seq)} ").alias("seq")) for name, seq in rules])

    def apply(s, r):
        fresh = F.struct(F.replace(s["left"], r["seq"], F.lit("|")).alias("left"), F.array_union(s["names"], F.array(r["name"])).alias("names"))
        return F.when(F.contains(s["left"], r["seq"]), fresh).otherwise(s)

    def matched(ids):
        left = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
        return F.aggregate(ordered, F.struct(left.alias("left"), none.alias("names")), apply, lambda s: s["names"])

    out = docs.withColumn("sentence_ids", ids)
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, let(F.col("sentence_ids"), matched)).otherwise(none))


def op8_license_scans(spark, sf_dir) -> DataFrame:
    docs = recognise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _oracle() -> str:
    values = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    steps, last = [], "ids"
    for no, (name, seq) in enumerate(RULES):
        pattern = f" {'  '.join(seq)} "
        steps.append(
            f"r{no} AS (SELECT doc_id, rid, CASE WHEN contains(left_, '{pattern}') THEN replace(left_, '{pattern}', '|') ELSE left_ END AS left_, "
            f"CASE WHEN contains(left_, '{pattern}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names, "
            f"n_sentences, sentence_ids FROM {last})"
        )
        last = f"r{no}"
    plain = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'))"
    ids = lambda x: (
        f"list_filter(list_transform(string_split(regexp_replace(lower({x}), '([.!?;:])\\s+', '\\1\n', 'g'), '\n'), lambda s: m[{plain('s')}]), "
        "lambda i: i IS NOT NULL)")
    keys, names = ", ".join(f"'{s}'" for s in SENTENCES.values()), ", ".join(f"'{i}'" for i in SENTENCES)
    # the blank lines between paragraphs, and the breaks inside one, without look-ahead
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid, MAP([{keys}], [{names}]) AS m FROM documents),
marked AS (SELECT *, regexp_replace(regexp_replace(text, '\n([ \t\r#*/;%-]*\n)+', '\x01\n', 'g'), '\n[ \t\r#*/;%-]*$', '\x02', 'g') AS t FROM doc),
par AS (SELECT rid, m, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS x FROM (SELECT rid, m, string_split(t, chr(1)) AS p FROM marked)),
two AS (SELECT rid, pos, {ids("x")} AS lines, {ids("regexp_replace(x, '" + chr(92) + "n[ " + chr(92) + "t#*/;%-]*', ' ', 'g')")} AS joined FROM par),
pick AS (SELECT rid, pos, CASE WHEN len(joined) > len(lines) THEN list_concat(joined, list_distinct(list_filter(lines, lambda i: NOT list_contains(joined, i))))
                ELSE list_concat(lines, list_distinct(list_filter(joined, lambda i: NOT list_contains(lines, i)))) END AS found FROM two),
found AS (SELECT rid, flatten(list(found ORDER BY pos)) AS ids FROM pick GROUP BY rid),
ids AS (SELECT doc_id, rid, ' ' || array_to_string(ids, '  ') || ' ' AS left_, CAST([] AS VARCHAR[]) AS names,
               CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids FROM doc JOIN found USING (rid)),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(names, ',') AS licenses FROM {last}
"""


ORACLE = _oracle()
