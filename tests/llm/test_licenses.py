from rankframe.llm import licenses as L

APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at\n\n http://example.org\n"
)


def test_known_sentences_are_normal_and_signed():
    import re

    for s in L.SENTENCES.values():
        assert re.search(L.SIGNS, s), s
    assert all(i in L.SENTENCES for _, seq in L.RULES for i in seq)


def test_ordered_rules(spark):
    cases = {
        APACHE: ["Apache-2.0"],
        "x\nReleased under the MIT License.\ny": ["MIT"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "MIT License\n\nReleased under the MIT licence. Licensed under CC BY 4.0": ["MIT", "CC-BY-4.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
        "The word license alone says nothing.": [],
        "": [],
        None: [],
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.text: r.licenses for r in L.recognise(docs).collect()}
    assert got == cases


def test_every_sentence_is_found_by_the_scan(spark):
    docs = spark.createDataFrame([(i, s.upper() + ".") for i, s in L.SENTENCES.items()], "doc_id string, text string")
    assert all(r.sentence_ids == [r.doc_id] for r in L.recognise(docs).collect())


def test_edges(spark, edge_docs, no_docs):
    assert L.recognise(edge_docs).count() == edge_docs.count()
    assert L.recognise(no_docs).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * See the GNU General Public License for more details.
 */
int main;
"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice,
#    this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
"""
APACHE_WRAPPED = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0
"""


def test_original_wrapped_texts(spark):
    cases = {MIT: ["MIT"], MIT.split("\n", 3)[3]: ["MIT"], GPL: ["GPL-3.0-or-later"], GPL.replace(":", ";"): ["GPL-3.0-or-later"], BSD: ["BSD-2-Clause"],
             APACHE_WRAPPED: ["Apache-2.0"], APACHE_WRAPPED.replace("\n", "\r\n"): ["Apache-2.0"], "prose without an end\nAll rights reserved.\nmore prose": ["proprietary"],
             MIT.replace("\n", " ").replace("  ", "\n"): ["MIT"], "all rights\nreserved": ["proprietary"], "all wrongs reserved": []}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert {r.text: r.licenses for r in L.recognise(docs).collect()} == cases


def test_every_license_line_of_the_tables_is_found(spark, sf):
    import re

    lines = re.compile(r"(?mi)^(this work is licensed under .*|all rights reserved\.|(licensed|released) under .*)$")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in L.recognise(docs).collect():
        assert bool(r.licenses) == bool(lines.search(r.text)), r.doc_id


def test_edge_values(spark, edge_docs):
    assert all(r.licenses == [] == r.sentence_ids for r in L.recognise(edge_docs).collect())
