"""Licence recognition by sentences and rules.

A text is split into sentences, these are normalised and looked up among known licence sentences; the identifiers that are
found, in the order of the text, form a sequence. Ordered rules are matched against it: a rule that matches takes its
identifiers out of the sequence, later rules see the rest, and what no rule takes is reported as left over.

All of it is expressions on one row; nothing is shuffled. Null and empty texts have no sentences. Repeats of a licence are
reported once, its sentences all.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, functions as F

# What public licence texts and notices say, by identifier.
NOTICES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref-the": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-ref-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
    " with the License.",
    "apache-copy": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    "mit-ref": "Released under the MIT License.",
    "mit-ref-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc0-ref": "Released under CC0 1.0.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to'
    " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
    " Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:",
    "bsd-use-numbered": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met:\n1.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
# Licences by the notices that must follow each other, in the order in which they are tried.
LICENCES = [
    ("BSD-3-or-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("BSD-3-or-2-Clause", ("bsd-use-numbered", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-ref", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-ref-you", "apache-copy")),
    ("Apache-2.0", ("apache-ref-you",)),
    ("Apache-2.0", ("apache-ref-the",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl-terms",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-licensed",)),
    ("MIT", ("mit-title",)),
]
#: Each known sentence has one of these, in any letter case; texts without them need no splitting.
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "released", "reserved")
# A mark ends a sentence, and so does an empty line; a heading or comment line before a sentence may lack a mark, so the
# last line of a sentence is looked up as well.
MARK = "\u0001"
ENDS = [r"([.!?;])[ \t\r\n]+", r"\n[ \t\r#*/]*\n"]


def pieces_of(notice: str) -> list[str]:
    """What `sentences_of` makes of a notice, normalised. Pieces without a stem ("2.0.") say nothing alone and are left out."""
    marked = re.sub(ENDS[1], MARK, re.sub(ENDS[0], r"\1" + MARK, notice))
    pieces = [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in marked.split(MARK)]
    return [x for x in pieces if any(stem in x for stem in STEMS)]


def derived() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Known sentences by identifier, and the rules over them.

    A notice that the splitter cuts is known by its pieces, and in one piece as well: others write a comma or a colon, or no
    empty line, where it is cut. Pieces that several notices share have one identifier.
    """
    sentences = {id: re.sub("[^a-z0-9]+", " ", notice.lower()).strip() for id, notice in NOTICES.items()}
    ids, forms = {words: id for id, words in sentences.items()}, {}
    for id, notice in NOTICES.items():
        pieces = pieces_of(notice)
        for k, words in enumerate(pieces, 1):
            if words not in ids:
                ids[words] = f"{id}-{k}"
                sentences[f"{id}-{k}"] = words
        forms[id] = list(dict.fromkeys([(id,), tuple(ids[words] for words in pieces)]))
    rules = []
    for licence, wanted in LICENCES:
        rules += [(licence, sum(run, ())) for run in itertools.product(*(forms[id] for id in wanted))]
    return sentences, list(dict.fromkeys(rules))


SENTENCES, RULES = derived()


def normal(sentence: Column) -> Column:
    """Lower case, words only: digits and letters of ASCII joined by one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences_of(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, ENDS[0], "$1" + MARK), ENDS[1], MARK)
    return F.split(marked, MARK)


def identifier(sentence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for id, words in SENTENCES.items() for x in (words, id)])
    # Without a pattern, which would try every place of a long line.
    bare = F.when(F.endswith(sentence, F.lit("\n")), F.substr(sentence, F.lit(1), F.length(sentence) - 1)).otherwise(sentence)
    last_line = F.substring_index(bare, "\n", -1)
    return F.coalesce(F.element_at(known, normal(sentence)), F.element_at(known, normal(last_line)))


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with `sentence_ids`, `licenses` and `left_over`, strings joined by commas.

    Columns of these names are replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "sentence_ids", "licenses", "left_over")]
    value = F.col(f"`{text}`").cast("string")
    may = value.rlike("(?i)" + "|".join(re.escape(x) for x in STEMS))
    ids = F.when(may, F.filter(F.transform(sentences_of(value), identifier), lambda x: x.isNotNull()))
    found = docs.select(*rest, F.coalesce(F.concat_ws(",", ids), F.lit("")).alias("sentence_ids"))
    left, licences = F.concat(F.lit(","), F.regexp_replace("sentence_ids", ",", ",,"), F.lit(",")), []
    for licence, wanted in RULES:
        run = "".join(f",{x}," for x in wanted)
        licences.append(F.when(F.contains(left, F.lit(run)), licence))
        left = F.replace(left, F.lit(run), F.lit(",,"))
    named = F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*licences)))))
    remaining = F.regexp_replace(F.regexp_replace(left, ",+", ","), "^,|,$", "")
    nothing = F.col("sentence_ids") == ""
    return found.withColumn("licenses", F.when(nothing, "").otherwise(named)).withColumn(
        "left_over", F.when(nothing, "").otherwise(remaining)
    )
