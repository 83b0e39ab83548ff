from strandloom.llm import license_scan as L

from ..helpers import rows_by

MIT = """Copyright (c) A. Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice."""


def report(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {k: v[0] for k, v in rows_by(L.license_report(df), "doc_id").items()}


def test_rules(spark):
    out = report(spark, [MIT, BSD, BSD + " Neither the name of X may be used.", "a.\nLicensed under the Apache License, Version 2.0.", BSD + "\n\n" + MIT, "No licence.", "You may not use this file except in compliance with the License.", "Released under the MIT License. Licensed under the MIT License."])
    assert [out[k].licences for k in range(8)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MIT,BSD-2-Clause", "", "", "MIT"]
    assert out[6].unmatched == "apache2_use" and out[0].n_sentences == 3 and out[7].n_sentences == 2


def test_order_of_identifiers_matters(spark):
    lines = BSD.split("\n")
    out = report(spark, ["\n".join(lines[::-1])])
    assert out[0].licences == "" and out[0].unmatched == "bsd_binary,bsd_source,bsd_grant"


def test_every_sentence_has_a_cue_and_is_found(spark):
    assert all(any(cue in s for cue in L.CUES) for _, s in L.SENTENCES)
    out = report(spark, [s for _, s in L.SENTENCES])
    assert all(name in out[k].sentence_ids.split(",") for k, (name, _) in enumerate(L.SENTENCES))
    assert {i for _, ids in L.RULES for i in ids.split()} == {i for i, _ in L.SENTENCES}


GPL = """    This {what} is free software: you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation, either version {version} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
NUMBERED = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list.
2. Redistributions in binary form must reproduce the above copyright notice.{endorse}

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND"""
HEADERS = [
    ("MIT", MIT), ("ISC", ISC), ("MPL-2.0", MPL), ("MPL-2.0", MPL.replace("v. 2.0", "V.\n * 2.0")), ("Apache-2.0", APACHE), ("BSD-2-Clause", NUMBERED.format(endorse="")),
    ("BSD-3-Clause", NUMBERED.format(endorse="\n3. Neither the name of the copyright holder nor others may be used.")),
    ("GPL-3.0-or-later", GPL.format(what="program", kind="", version="3")), ("GPL-2.0-or-later", GPL.format(what="program", kind="", version="2")),
    ("LGPL-3.0-or-later", GPL.format(what="library", kind="Lesser ", version="3")), ("LGPL-2.1-or-later", GPL.format(what="library", kind="Lesser ", version="2.1")),
    ("AGPL-3.0-or-later", GPL.format(what="program", kind="Affero ", version="3")), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD", "Licensed under the BSD License."), ("CC0-1.0", "Dedicated to the public domain under CC0."), ("all-rights-reserved", "(c) X. All rights reserved."),
    *((f"CC-{k}-4.0", f"This work is licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    ("0BSD", ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation'), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it."),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at"), ("EPL-2.0", "All rights are made available under the terms of the Eclipse Public License v. 2.0."),
    ("EPL-1.0", "are made available under the terms of the Eclipse Public License v1.0".replace("v1", "v 1")), ("AFL-3.0", "Licensed under the Academic Free License version 3.0"), ("Artistic-2.0", "Licensed under the Artistic License 2.0"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"), ("Apache-2.0", "Licensed under the Apache License 2.0."), ("Apache-2.0", "It is released under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"), ("ISC", "Licensed under the ISC license"),
    *((k, f"// SPDX-License-Identifier: {v}\n\ncode") for k, v in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-2.0-or-later", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0-or-later", "GPL-3.0-or-later"))),
    ("", "This is not licensed under the MIT License."),
    ("GPL", GPL.format(what="program", kind="", version="9").replace("either version 9 of the License, or\n    (at your option) any later version", "any version")),
]


def test_rules_on_headers(spark):
    out = report(spark, [text for _, text in HEADERS])
    assert [(out[k].licences, out[k].unmatched) for k in range(len(HEADERS))] == [(name, "") for name, _ in HEADERS]


GPL_ONLY = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version {v} as\npublished by the Free Software Foundation."
ASF = """/* Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with the License.  You may obtain a copy of the License at */"""
BSD4 = NUMBERED.format(endorse="\n3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement: This product includes software.\n4. Neither the name of X nor others may be used.")
tag = "// SPDX-License-Identifier: "
#: Licences as a reader would name them.
BY_HAND = [
    ("BSD-4-Clause", BSD4), ("MIT OR Apache-2.0", tag + "MIT OR Apache-2.0"), ("MIT-0", tag + "MIT-0"), ("BSD-3-Clause-LBNL", tag + "BSD-3-Clause-LBNL"), ("", "This is not, and never was, licensed under the MIT License."),
    ("", "No part of this is licensed under the MIT License."), ("GPL-2.0", GPL_ONLY.format(v=2)), ("LGPL-2.0-or-later", GPL.format(what="library", kind="Library ", version="2")), ("LGPL-2.1-or-later", tag + "LGPL-2.1-or-later"),
    ("AGPL-3.0", tag + "AGPL-3.0-only"), ("EPL-2.0", tag + "EPL-2.0"), ("Apache-2.0", ASF), ("MIT", "MIT License"), ("MIT", "Licensed under MIT"), ("MIT", "The MIT License\n\n" + MIT), ("MIT", "Licensed under MIT."),
    ("GPL-3.0", GPL_ONLY.format(v=3)), ("GPL-2.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("LGPL-2.1", GPL_ONLY.format(v="2.1").replace("GNU General", "GNU Lesser General")), ("(MIT OR Apache-2.0) AND BSD-3-Clause", tag + "( MIT  or Apache-2.0 ) and BSD-3-Clause */ int x"),
    ("GPL-2.0 WITH Classpath-exception-2.0", "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"), ("GPL-2.0-or-later", tag + "GPL-2.0+"), ("MIT", tag + "MIT and what follows is text".replace("and", "is")),
    ("LicenseRef-Own", tag + "LicenseRef-Own."), ("", tag + "NONE"), ("", tag + "NOASSERTION\n"), ("MIT,ISC", tag + "MIT\n" + tag + "ISC\n" + tag + "MIT"), ("MIT", MIT + "\n" + tag + "MIT"),
    ("", "Neither this nor that is licensed under the Apache License, Version 2.0."), ("MIT", "It is not free of cost, but licensed under the MIT License."), ("Apache-2.0", "This is not part of Spark and is licensed under the Apache License, Version 2.0."),
    ("", "The code isn't licensed under the BSD License."), ("", "It is no longer licensed under the ISC license."), ("MIT-0", "Licensed under the MIT-0 license."), ("MIT OR Apache-2.0", "Licensed under the MIT license or the Apache License, Version 2.0."),
    ("MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright"), ("MIT", "License: MIT"), ("Apache-2.0", "License: Apache-2.0\n"),
    ("MIT-0", MIT.replace("The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "")), ("MIT", "This library is available under the MIT license."),
    ("", "A mitigation license was discussed."), ("", "Ask for permission; the MIT press holds a copyright."), ("", "licensed under MIT terms that we changed"), ("", "The licence of the driver."), ("Apache-2.0,MIT", "Licensed under the Apache License, Version 2.0. The rest is licensed under the MIT License."),
    ("", "None of it is released under the MIT License."), ("ISC", "ISC License\n\n" + ISC), ("CC-BY-4.0", "Text: licensed under CC BY 4.0."), ("MPL-2.0", tag + "MPL-2.0 -->"), ("MIT,BSD-4-Clause", MIT + "\n\n" + BSD4), ("LicenseRef-BSD-advertising", BSD4.replace("\n4. Neither the name of X nor others may be used.", "")),
]


def test_licences_by_hand(spark):
    out = report(spark, [text for _, text in BY_HAND])
    found = [(",".join(sorted(out[k].licences.split(","))), text) for k, (_, text) in enumerate(BY_HAND)]
    assert found == [(",".join(sorted(name.split(","))), text) for name, text in BY_HAND] and len(found) >= 50
    assert {name for name, _ in (*HEADERS, *BY_HAND)} >= {name for name, _ in L.RULES}


def test_sql_says_the_same(spark):
    import duckdb

    texts = [t for _, t in (*BY_HAND, *HEADERS) if "v. " not in t.lower() and "v.\n" not in t.lower()]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = db.execute(f"SELECT doc_id, licences, unmatched, spdx, sentence_ids FROM ({L.ORACLE_SQL['op9_license_scan']})").fetchall()
    out = report(spark, texts)
    assert sorted(rows) == sorted((k, r.licences, r.unmatched, r.spdx, r.sentence_ids) for k, r in out.items())


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "All rights reserved", 7), (2, "", 6), (3, "Licensed under CC BY-NC 4.0. " * 5000, 1)], "doc_id bigint, text string, licences int")
    out = rows_by(L.license_report(df), "doc_id")
    assert len(out[2]) == 2 and out[1][0].licences == "" and out[None][0].licences == "all-rights-reserved" and out[3][0].n_sentences == 5000 and out[3][0].licences == "CC-BY-NC-4.0"
    assert L.license_report(df.limit(0)).count() == 0
