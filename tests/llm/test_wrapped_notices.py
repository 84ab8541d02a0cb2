"""Licence notices in their usual wrapped form."""

import textwrap

import numpy as np
import pytest

from tidemark.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
NOTICES = {"MIT": MIT, "BSD": BSD, "Apache-2.0": APACHE, "GPL": GPL, "LGPL": LGPL}


@pytest.fixture(scope="module")
def plain():
    random = np.random.RandomState(3)
    words = ["".join(random.choice(list("aeionrst"), 5)) for _ in range(200)]
    return [" ".join(random.choice(words, 12)) for _ in range(120)]


def test_wrapped_notices_are_found_by_their_run_of_lines(spark, plain):
    rows, want = [(i, f"{t}\n{plain[-i - 1]}") for i, t in enumerate(plain)], {}
    for family, text in NOTICES.items():
        for width in (40, 72, 80):
            for first, mark in (("", ""), ("/*", " * "), ("#", "# "), ("dnl", "dnl ")):
                notice = "\n".join(mark + x for x in textwrap.wrap(text, width))
                want[1_000 + len(want)] = family
                rows.append((999 + len(want), f"{first}\n{mark}Some name\n{mark.rstrip()}\n{notice}\n{mark.rstrip()}\n{mark}{plain[len(want)]}"))
    talk = "The driver is licensed and the general\npublic was under it. Permission is hereby\nasked of any person with a copy of this software."
    docs = spark.createDataFrame([*rows, (2_000, talk), (2_001, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.licence_scan(docs, licenses.fit_licences(docs)).collect()}
    assert len(out) == len(rows) + 2
    found = {i: out[i].licences for i in want}
    assert found == {i: [family] for i, family in want.items()}
    assert all(out[i].licences == [] and out[i].paragraph is None for i in out if i not in want)
