"""License phrases and notices by diagonal voting.

Every document's rolling word k-grams are hashed and joined by Spark with the positions of the same
k-grams in a fixed set of templates. A match votes for the offset diagonal (place in the text less
place in the template). A phrase stands where one diagonal has every place. A longer notice may have
words put in or left out: the diagonals next to a seed, one that has the most votes around, are
merged with it, and the span is verified by itself: by its share of distinct template places and by
its length. Of templates that fit the same words the best one counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BASE, WordHashes, mixed, pieces

# Phrases that are found word for word, and wording of public licenses and their notices.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd",
    "licensed under a creative commons attribution 3 0 unported license": "cc-by",
    "licensed under a creative commons attribution sharealike 3 0 unported license": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial 3 0 unported license": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "distributed under the boost software license version 1 0": "boost",
    # GNU Affero GPL, the beginning of its notice for files.
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    # MIT, whole.
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
    "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    # Apache 2.0, the notice for files.
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    # BSD with three clauses, and with two.
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source "
    "code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder "
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source "
    "code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    # ISC, whole.
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
    "of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
    "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    # zlib.
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
    "restrictions": "zlib",
    # GNU GPL and LGPL, the notices for files.
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
    "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
    "either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details": "agpl",
    # Mozilla, the notice for files.
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
    "https mozilla org mpl 2 0": "mpl-2",
    # Boost.
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
    "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is "
    "furnished to do so all subject to the following": "boost",
    # Unlicense.
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
    "form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}
#: Bytes of words as they are, A-Z lower-cased, all others a space.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
DOCUMENT = xxhash.xxh64_intdigest(b"a document") - (1 << 63)
#: Words of a rolling k-gram.
K = 3
#: Diagonals of a notice may be this far from its seed: 3 words, 6 from 40 words on, 12 from 120 on.
DRIFTS = ((0, 3), (40, 6), (120, 12))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def gram_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k words in a row, signed."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + hashes[i : i + n]
    return mixed(out).view(np.int64)


def templates(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(hash, template, place) of all templates' word k-grams, and one row that every document's own row meets."""
    seen, rows = WordHashes(), [(DOCUMENT, -1, 0)]
    for t, text in enumerate(texts):
        words = words_of(text.encode())
        if len(words) < K:
            raise ValueError(f"a template has {K} words or more")
        rows += [(int(h), t, i) for i, h in enumerate(gram_hashes(seen.of(words)))]
    return spark.createDataFrame(rows, "hash long, template int, place int")


def word_grams(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at, hash) of every word k-gram; one more row a document, whose ``at`` is its number of words."""

    def run(batches):
        seen, row = WordHashes(), TaskContext.get().partitionId() << 40
        for b in pieces(batches, "text", 2 << 20):
            places, hashes, sizes = [], [], []
            for t in b.column("text").to_pylist():
                w = words_of(t)
                grams = gram_hashes(seen.of(w))
                places += [np.arange(len(grams), dtype=np.int32), np.array([len(w)], dtype=np.int32)]
                hashes += [grams, np.array([DOCUMENT])]
                sizes.append(len(grams) + 1)
            at = np.repeat(np.arange(b.num_rows), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + at), b.column("doc_id").take(pa.array(at)), pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes))],
                names=["row", "doc_id", "at", "hash"],
            )
            row += b.num_rows

    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return text.mapInArrow(run, "row long, doc_id long, at int, hash long")


def _diagonals(votes: DataFrame) -> DataFrame:
    """One row a diagonal: its places (each once: on a diagonal the place in the text gives that in the
    template), their number n, and the first and last place in the text that voted."""
    return votes.groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("n"), F.collect_list("place").alias("places"),
        (F.col("diagonal") + F.min("place")).alias("start"), (F.col("diagonal") + F.max("place") + K - 1).alias("stop"),
    )


def _merged(diagonals: DataFrame, is_notice, least, drift) -> DataFrame:
    """A notice's candidates: around each seed (most votes of all diagonals within drift, enough of them)
    the diagonals within drift, with the distinct places of them all. Other rows pass as they are."""
    unit = DRIFTS[-1][1]
    near = W.partitionBy("row", "template").orderBy("scaled").rangeBetween(-unit, unit)
    scaled = diagonals.withColumn("scaled", F.col("diagonal").cast("long") * (F.lit(unit) / drift).cast("long"))
    rank = F.struct("n", (-F.col("diagonal")).alias("d"))
    seeds = scaled.withColumn("seed", is_notice & (F.col("n") * (2 * drift + 1) >= least) & (F.max(rank).over(near) == rank))
    kept = seeds.withColumn("close", F.max("seed").over(near)).where(~is_notice | F.col("close"))
    return (
        kept.withColumn("matched", F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))))
        .withColumn("first", F.min("start").over(near)).withColumn("last", F.max("stop").over(near))
        .where(~is_notice | F.col("seed")).drop("places")
    )


def _best(spans: DataFrame, is_notice) -> DataFrame:
    """Of notices that stand on the same words (their spans overlap by more than some words at the ends,
    directly or over others) the one with the most places matched, then the largest share. Other rows
    pass as they are."""
    cut = F.least((F.col("words") / 4).cast("int"), F.lit(6))
    cores = spans.withColumn("notice", is_notice).withColumn("a", F.col("first") + cut).withColumn("z", F.col("last") - cut)
    line = W.partitionBy("row", "notice").orderBy("a", "z", "template")
    before = F.max("z").over(line.rowsBetween(W.unboundedPreceding, -1))
    islands = cores.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(line))
    best = W.partitionBy("row", "notice", "island").orderBy(F.desc("matched"), F.desc("share"), "template", "first")
    return islands.withColumn("place", F.row_number().over(best)).where(~F.col("notice") | (F.col("place") == 1))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, share: float = 0.8) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans (of notices: start, length, label, share).

    n_base counts all places of ``phrases``; first_word and last_word are their smallest and largest
    start. A notice counts from ``share`` of its k-grams on diagonals around a seed (DRIFTS), in a span
    of at most 1.3 times its length; where notices stand on the same words the best one counts (of
    equal ones the first of ``notices``). score is the largest share found (1 for a phrase, 0 for
    none). Null and empty texts have no words, texts of any length count whole; no label is an empty
    string; repeated rows count each; other columns are ignored; an empty table gives no rows."""
    texts = [*phrases, *notices]
    size = [len(words_of(t.encode())) for t in texts]
    labels = [*phrases.values(), *notices.values()]
    drifts = [max(d for n, d in DRIFTS if s >= n) for s in size]
    pick = lambda values, other: F.element_at(F.array(*[F.lit(v) for v in [other, *values]]), F.col("template") + 2)
    is_phrase, is_notice = F.col("template").between(0, len(phrases) - 1), F.col("template") >= len(phrases)
    label, length, grams = pick(labels, ""), pick(size, 1), pick([s - K + 1 for s in size], 1)
    # A fixed table: a row for each word of the templates.
    votes = word_grams(docs).join(F.broadcast(templates(docs.sparkSession, texts)), "hash")
    votes = votes.select("row", "doc_id", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place")
    # All that follows is by row, so votes move once; a row's votes are bounded by its own words.
    spans = _merged(_diagonals(votes.repartition("row")), is_notice, share * grams, pick(drifts, DRIFTS[-1][1]))
    spans = spans.withColumn("words", F.col("last") - F.col("first") + 1)
    spans = spans.withColumn("share", F.when(is_notice, F.col("matched") / grams).otherwise(F.col("n") / grams))
    fits = is_notice & (F.col("share") >= share) & (F.col("words") <= length + F.greatest(F.lit(DRIFTS[0][1]), 0.3 * length))
    spans = _best(spans.where((F.col("template") < 0) | (is_phrase & (F.col("share") == 1)) | fits), is_notice)
    found = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, label))), ",")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("template") < 0, F.col("diagonal"))).cast("long").alias("n_words"),
        F.count(F.when(is_phrase, 1)).alias("n_base"),
        F.min(F.when(is_phrase, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(is_phrase, F.col("diagonal"))).cast("long").alias("last_word"),
        found(is_phrase).alias("base_labels"), found(F.col("template") >= 0).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(is_notice, F.struct(F.col("first").alias("start"), F.col("words").alias("length"), label.alias("label"), "share"))).alias("spans"),
    ).drop("row")
