"""Usual licence headers as they stand in files, each with its own version."""

from txsentry.llm import licenses as L
from txsentry.llm import queries

GPL = """This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU {} as published by
# the Free Software Foundation{} either version {} of the License, or
# (at your option) any later version.
# This program is distributed in the hope that it will be useful"""
BSD = """* Redistribution and use in source and binary forms, with or without modification, are permitted provided that
 * the following conditions are met:
 * {} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * {} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
 * disclaimer in the documentation and/or other materials provided with the distribution."""
CASES = [
    (GPL.format(":", "General Public License", ",", "3"), ["GPL-3-header"]),
    (GPL.format(";", "General Public License", ";", "2"), ["GPL-2-header"]),
    (GPL.format(":", "Lesser General Public License", ",", "3"), ["LGPL-3-header"]),
    (GPL.format(";", "Lesser General Public License", ";", "2.1"), ["LGPL-2.1-header"]),
    (GPL.format(":", "Affero General Public License", ",", "3"), ["AGPL-3-header"]),
    ("it is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"
     " as published by the Free Software Foundation.", ["GPL-2.0-only-header"]),
    (BSD.format("1.", "2."), ["BSD-2-Clause-text"]),
    (BSD.format("1.", "2.") + " 3. Neither the name of the author nor the names of its contributors may be used to endorse or"
     " promote products derived from this software without specific prior written permission.", ["BSD-3-Clause-text"]),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided"
     " that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("plain words about redistribution and use of a general public library of many books", []),
]


def test_headers_are_found_under_their_own_name(spark, monkeypatch):
    rows = [(i, ("filler " * (i * 7 % 50)) + text + " and more text" * 20) for i, (text, _) in enumerate(CASES)]
    got = {}
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    for r in queries.op5_license_scan(spark, "").collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {i: sorted(got.get(i, [])) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
