"""License scans by diagonal voting, native.

Every rolling pair of a document's words is joined to the places where it stands in the license
templates: short phrases and whole license texts. A hit votes for a diagonal (document place minus template
place): a whole phrase puts all its pairs on one. Neighbouring diagonals - a few words put in or left out - are
merged for the long templates, and the merged span is verified in the order of the document's words: only pairs that
go on in the template's order count, and enough of the template must be there. Pairs are compared as words,
not hashes alone, so a phrase with all its pairs on one diagonal is there word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

# fixed values
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
OWN_TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl-notice",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
}
#: Whole texts: of these, a part of ``TEXT_SHARE`` in order is enough.
LICENSE_TEXTS = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is
provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must
retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission
notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness""",
    "apache-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache
org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
express or implied see the license for the specific language governing permissions and limitations under the license""",
    "gpl-text": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version
of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for
a particular purpose see the gnu general public license for more details""",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission
is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must
not be misrepresented you must not claim that you wrote the original software""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a
compiled binary for any purpose commercial or non commercial and by any means""",
}
TEXT_SHARE = 0.6
#: Pairs of two of these stand everywhere and do not vote for whole texts.
COMMON = frozenset("a all an and any as at be by for from in is it no not of on or that the this to under will with you".split())


@dataclass(frozen=True)
class Template:
    """A phrase and its label; ``base`` phrases count only whole, others from ``least`` of their pairs."""

    words: tuple[str, ...]
    label: str
    base: bool
    least: float = 0.8
    #: Diagonals this far apart are neighbours.
    reach: int = 2

    def places(self) -> list[tuple[int, str]]:
        """(place, pair) of the pairs that vote: all of a phrase, those of a text that are not common."""
        pairs = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(self.words, self.words[1:]))]
        return pairs if self.base or len(self.words) < 40 else [(i, p) for i, p in pairs if not COMMON.issuperset(p.split())]


def templates() -> list[Template]:
    found = [Template(tuple(p.split()), label, True) for p, label in BASE_PHRASES.items()]
    found += [Template(tuple(p.split()), label, False) for p, label in OWN_TEMPLATES.items()]
    return found + [Template(tuple(p.split()), label, False, TEXT_SHARE, 6) for label, p in LICENSE_TEXTS.items()]


def pairs_table(spark: SparkSession, every: list[Template]) -> DataFrame:
    """gram hash, gram, template number, place: as many rows as the templates have pairs."""
    rows = [(pair, i, at) for i, t in enumerate(every) for at, pair in t.places()]
    df = spark.createDataFrame(rows, "gram string, template int, place int")
    return df.select(F.xxhash64("gram").alias("hash"), "gram", "template", "place")


def scanned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", every: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and wordless texts have no words and empty labels (""). Repeated rows are scanned once and
    returned as often as they came; null ids are kept. ``score`` is the largest share of a
    template's pairs found on one span, 0 without hits; base phrases score 1.
    """
    every = every or templates()
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same"), words.alias("words"))
    # the first element, null, stands for the document itself
    grams = F.expr("concat(array(cast(null as string)), transform(slice(words, 2, size(words)), (w, i) -> concat(words[i], ' ', w)))")
    placed = rows.select("doc_id", "same", F.size("words").cast("long").alias("n_words"), F.posexplode(grams).alias("at", "own"))
    placed = placed.withColumn("own_hash", F.xxhash64("own"))
    table = F.broadcast(pairs_table(spark, every))  # a constant of this module: some hundred rows
    hits = placed.join(table, (F.col("own_hash") == F.col("hash")) & (F.col("own") == F.col("gram")), "left")
    hits = hits.where(F.col("template").isNotNull() | (F.col("at") == 0))
    document = ["doc_id", "same", "n_words"]
    votes = hits.groupBy(*document, "template", (F.col("at") - 1 - F.col("place")).alias("diagonal"), "place").agg(F.count(F.lit(1)).alias("copies"))
    lines = votes.groupBy(*document, "template", "diagonal").agg(F.collect_list("place").alias("places"), F.max("copies").alias("copies"))

    def of(pick, default) -> F.Column:
        out = F.lit(default)
        for i, t in enumerate(every):
            out = F.when(F.col("template") == i, F.lit(pick(t))).otherwise(out)
        return out

    along = Window.partitionBy(*document, "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    runs = lines.withColumn("opens", F.when(of(lambda t: t.base, False) | step.isNull() | (step > of(lambda t: t.reach, 0)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("opens").over(along))
    # a span's pairs in the order of the document, of which those count that go on in the template's order
    hit = F.transform("places", lambda p: F.struct((p + F.col("diagonal")).alias("at"), p.alias("place")))
    spans = runs.withColumn("hit", hit).groupBy(*document, "template", "run").agg(F.array_sort(F.flatten(F.collect_list("hit"))).alias("hits"), F.min("diagonal").alias("start"), F.max("copies").alias("copies"))
    chain = F.aggregate("hits", F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), lambda acc, h: F.when(h["place"] > acc["last"], F.struct(h["place"].cast("int").alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc))
    spans = spans.select(*document, "template", "start", "copies", chain["n"].alias("found"))
    share = F.col("found") / of(lambda t: len(t.places()), 1)
    base = of(lambda t: t.base, False) & (share >= 1.0)
    shown = base | (~of(lambda t: t.base, False) & (share >= of(lambda t: t.least, 2.0)))
    label = of(lambda t: t.label, None)
    joined = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, label))), ",")
    found = spans.groupBy(*document).agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(shown).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), share)), F.lit(0.0)).alias("score"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts of every document: ``scanned`` with all templates."""
    return scanned(read(spark, sf_dir, "documents"))
