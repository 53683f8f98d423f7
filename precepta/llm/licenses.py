"""License scans by a positional index of rare licence words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precepta.llm.common import alphanumeric_words, cut

#: Highest-IDF words of each template that are looked up, and the share of their weight that must be aligned.
LOOKED_UP, LEAST_SCORE = 8, 0.5
# Phrases of the base labels; notices and whole texts of licences; key phrases, of which a template needs
# one that it has. Key phrases have none of the COMMON words, so that each of their words is compared.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software"""
_BSD_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""
TEMPLATES = {
    "mit": [
        "released under the mit license",
        f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and
        or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}""",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "spdx license identifier mit",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
        copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license""",
        "spdx license identifier apache 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it
        will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
        general public license for more details""",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "spdx license identifier gpl 2 0 or later",
        "spdx license identifier gpl 3 0 only",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 3",
        """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published
        by the free software foundation either version 2 1 of the license or at your option any later version""",
        "spdx license identifier lgpl 2 1 or later",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published
        by the free software foundation either version 3 of the license or at your option any later version""",
        "spdx license identifier agpl 3 0 only",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        _BSD_CONDITIONS,
        f"""{_BSD_CONDITIONS} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""",
        "bsd 2 clause license",
        "bsd 3 clause license",
        "spdx license identifier bsd 3 clause",
    ],
    "isc": [
        "licensed under the isc license",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
        regard to this software including all implied warranties of merchantability and fitness""",
        "spdx license identifier isc",
    ],
    "zlib": [
        """altered source versions must be plainly marked as such and must not be misrepresented as being the original software""",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
        from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
        alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must
        not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be
        appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original
        software 3 this notice may not be removed or altered from any source distribution""",
        "spdx license identifier zlib",
    ],
    "unlicense": [
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
        this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
        "spdx license identifier unlicense",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
        can obtain one at http mozilla org mpl 2 0""",
        "spdx license identifier mpl 2 0",
    ],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0", "spdx license identifier cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
}
KEYS = {
    "mit": ["mit license", "hereby granted free", "identifier mit"],
    "apache": ["apache license version 2 0", "identifier apache"],
    "gpl": ["gnu general public license", "identifier gpl"],
    "lgpl": ["gnu lesser general public license", "identifier lgpl"],
    "agpl": ["gnu affero general public license", "identifier agpl"],
    "bsd": ["binary forms", "bsd 2 clause", "bsd 3 clause"],
    "isc": ["isc license", "permission notice appear", "identifier isc"],
    "zlib": ["altered source versions", "identifier zlib"],
    "unlicense": ["unencumbered software released", "identifier unlicense"],
    "mpl": ["mozilla public license", "identifier mpl"],
    "cc-by": ["commons attribution 4 0", "cc by 4 0"],
    "cc-by-nc": ["cc by nc 4 0", "attribution noncommercial 4 0"],
    "cc-by-sa": ["cc by sa 4 0", "attribution sharealike 4 0"],
}
#: Words that say nothing about licences: not indexed, and left open where a template has them.
COMMON = frozenset("a all an and any are as at be been but can for from if in including is it its met may must no nor not of on one or out person see shall subject such terms that the this to under use was will with without work you your".split())
END = " "
PLACED = "label string, phrase string, place int, word string, n int, key int"


def _places(words: list[str], part: list[str]) -> list[int]:
    return [k for k in range(len(words) - len(part) + 1) if words[k : k + len(part)] == part]


def placed_words(texts: dict[str, list[str]], keys: dict[str, list[str]]) -> list[tuple]:
    """Rows of PLACED: the words of texts that aren't COMMON, with their places; n counts those of the text.

    key: of how many words the key phrase is that begins here, else 0; each text must have one of its label's keys.
    """
    out = []
    for label, phrases in texts.items():
        for words in map(str.split, phrases):
            at = {k: len(key.split()) for key in keys[label] for k in _places(words, key.split())}
            if not at or any(COMMON.intersection(words[k : k + n]) for k, n in at.items()):
                raise ValueError(f"{label}: a template needs a key phrase without common words: {' '.join(words)}")
            kept = [(i, w) for i, w in enumerate(words) if w not in COMMON]
            out += [(label, " ".join(words), i, w, len(kept), at.get(i, 0)) for i, w in kept]
    return out


def license_postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(row, doc_id, word, position) of words (word) in docs, and for each row of docs one of END at its number of words."""
    text = F.concat(alphanumeric_words(F.col("text").cast("string")), F.array(F.lit(END)))
    each = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("words")).select("row", "doc_id", F.posexplode("words").alias("position", "word"))
    wanted = words.select("word").union(words.sparkSession.createDataFrame([(END,)], "word string")).distinct()
    return each.join(F.broadcast(wanted), "word").select("row", "doc_id", "word", "position")


def license_scan(docs: DataFrame, looked_up: int = LOOKED_UP, least_score: float = LEAST_SCORE, templates: dict[str, list[str]] = TEMPLATES, keys: dict[str, list[str]] = KEYS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and other non-ASCII characters of the text with A-Z lower-cased. n_base counts the
    places where the words of a base phrase stand consecutively; first_word and last_word are their first and last
    starts. base_labels and labels: distinct, sorted, comma-joined, empty if there are none; labels has the base ones
    and those of the method. score: the best share of a template's looked-up weight that is aligned, 1 where a base
    phrase stands, 0 without any label.

    One scan stores the positions of the words of templates; texts aren't shuffled. A word's IDF counts the documents
    that have it, over all of docs. Each template's highest-IDF words, and those of its key phrases, are looked up in the
    postings; those at one relative position add up, and a template gives its label where an alignment has a whole key
    phrase and least_score of the template's own weight, whatever else stands in the file. Templates, their keys and
    phrases are constants or arguments, so broadcasts are of fixed size.

    Null and empty texts have no words and no labels. Rows are told apart by their place: repeated rows and null ids
    are each judged on their own text. Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    phrases = F.broadcast(spark.createDataFrame(placed_words({k: [v] for k, v in PHRASES.items()}, {k: [v] for k, v in PHRASES.items()}), PLACED))
    placed = placed_words(templates, keys)
    known = F.broadcast(spark.createDataFrame(placed, PLACED))
    in_key = [(label, phrase, i, i + k, n) for label, phrase, i, _, _, n in placed if n for k in range(n)]
    key_words = F.broadcast(spark.createDataFrame(in_key, "label string, phrase string, key_place int, place int, key_words int"))
    index = cut(license_postings(docs.select("doc_id", "text"), phrases.union(known).select("word").distinct()))
    words = index.where(F.col("word") != END)

    # base phrases: all their words at one offset
    start = (F.col("position") - F.col("place")).alias("start")
    base = words.join(phrases, "word").where("position >= place").groupBy("row", "label", "n", start).agg(F.count("*").alias("found")).where("found = n")
    base = base.groupBy("row").agg(F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base"))

    found = words.select("row", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))  # a row for each licence word
    total, df = index.where(F.col("word") == END).count(), F.coalesce("df", F.lit(0))
    idf = F.log(1 + (F.lit(float(total)) - df + 0.5) / (df + 0.5))
    terms = known.select("phrase", "word").distinct().join(F.broadcast(found), "word", "left").select("phrase", "word", idf.alias("idf"))
    rare = terms.withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("idf"), "word")))  # as many rows as a template has words
    rare = rare.withColumn("part", F.when(F.col("rank") <= looked_up, F.col("idf")).otherwise(0.0)).withColumn("part", F.col("part") / F.sum("part").over(Window.partitionBy("phrase")))
    sought = known.join(rare, ["phrase", "word"]).join(key_words, ["label", "phrase", "place"], "left").where("part > 0 OR key_place IS NOT NULL")
    sought = cut(sought.groupBy("label", "phrase", "place", "word", "part").agg(F.collect_list(F.when(F.col("key_place").isNotNull(), F.struct("key_place", "key_words"))).alias("keys")))
    shift = (F.col("position") - F.col("place")).alias("shift")
    aligned = words.join(F.broadcast(sought), "word").select("row", "label", "phrase", shift, "word", "part", F.explode_outer("keys").alias("key"))
    # of each alignment: the weight of its distinct words, and whether all words of one key phrase are in place
    per_key = aligned.groupBy("row", "label", "phrase", "shift", "key").agg(F.count("*").alias("n"), F.collect_set(F.struct("word", "part")).alias("found"))
    per_shift = per_key.groupBy("row", "label", "phrase", "shift").agg(F.max(F.coalesce(F.col("n") >= F.col("key.key_words"), F.lit(False))).alias("whole"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    share = F.aggregate("found", F.lit(0.0), lambda total, x: total + x["part"])
    scored = per_shift.where("whole").groupBy("row", "label").agg(F.max(share).alias("share"))
    method = scored.where(F.col("share") >= least_score).groupBy("row").agg(F.collect_set("label").alias("method"), F.max("share").alias("share"))

    none = F.array().cast("array<string>")
    lengths = index.where(F.col("word") == END).select("row", "doc_id", F.col("position").cast("long").alias("n_words"))
    joined = lengths.join(base, "row", "left").join(method, "row", "left")
    base_labels, method_labels = F.coalesce("base", none), F.coalesce("method", none)
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0)))
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), listed(base_labels).alias("base_labels"), listed(F.array_union(base_labels, method_labels)).alias("labels"), score.alias("score"))
