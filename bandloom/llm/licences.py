"""Licence scans: a positional index of rare licence words, in DataFrame functions alone.

One pass over the texts keeps, per row, how many words it has, which words of the licence vocabulary
stand in it, and the base phrases. A template can only reach ``least`` in a row that holds so many of
its distinct words; for such rows alone the places of those words are kept, too. The rest works on
that table, without texts:

1. Document frequencies of the vocabulary come from all rows.
2. For a row and a template the words looked up are the row's highest-IDF ones of that template, as
   many as it takes for any stretch that reaches ``least`` to hold ``agree`` of them (what the row has
   of the template, less what the stretch needs, plus ``agree``): nothing is lost by looking up no more.
3. Each place of such a word votes, by the template's postings, for where the template would begin.
   Votes of ``agree`` different words that lie within ``gap`` of each other make a candidate: inserted
   or missing words move a beginning by no more than their number.
4. Around candidates all words of the template vote. A stretch's score is the share of the template's
   distinct words that vote within ``gap``; it counts if it reaches ``least`` and the words of the
   template's mandatory key phrase stand there one after the other.

Null and empty texts have no words; then first_word and last_word are null, labels empty and the
score 0. Repeated rows give repeated results. Extra columns are ignored. Votes are grouped by row and
template, so a licence that very many files have is no hot key.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

#: Base phrases (as words) and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, mandatory key phrase and wording of licences and notices, as published.
TEMPLATES = (
    ("mit", "permission is hereby granted", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "permission is hereby granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "Released under the MIT License"),
    ("isc", "permission to use copy modify", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", "source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", "source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("apache-2", "apache license version 2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "either version 3 of the license", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3", "gnu general public license version 3", "Licensed under the GNU General Public License version 3"),
    ("gpl", "gnu general public license", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "gnu affero general public license", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "released into the public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("zlib", "altered source versions must be plainly marked", """The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be
        removed or altered from any source distribution."""),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "attribution 4 0 international", "Creative Commons Attribution 4.0 International License"),
    ("proprietary", "all rights reserved", "All rights reserved"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


@dataclass
class Template:
    """A template's words, its distinct ones, how many of them a stretch needs, and the place of its key phrase."""

    label: str
    words: list[str]
    key: int
    key_words: int
    distinct: list[str]
    need: int


def parsed(templates=TEMPLATES, least: float = 0.6) -> list[Template]:
    out = []
    for label, key, text in templates:
        own, key = re.findall(WORD, text.lower()), key.split()
        distinct = sorted(set(own))
        at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        # as the share is compared: n words reach it if n / all >= least
        need = next(n for n in range(1, len(distinct) + 1) if n / len(distinct) >= least)
        out.append(Template(label, own, at, len(key), distinct, need))
    return out


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def _phrase_places(w: Column, present: Column, phrase: list[str], number: int) -> Column:
    """(number, place) of each place where the phrase stands in w."""
    n = len(phrase)
    stands = lambda i: functools.reduce(operator.and_, (F.element_at(w, i + (k + 1)) == p for k, p in enumerate(phrase)))
    here = F.filter(F.sequence(F.lit(0), F.size(w) - n), stands)
    may = (F.size(w) >= n) & (F.size(F.array_intersect(_texts(sorted(set(phrase))), present)) == len(set(phrase)))
    return F.when(may, F.transform(here, lambda i: F.struct(F.lit(number).alias("b"), i.cast("int").alias("at")))).otherwise(F.array().cast("array<struct<b:int,at:int>>"))


def hits(docs: DataFrame, templates: list[Template], base) -> DataFrame:
    """Per row: a number, doc_id, n_words, the vocabulary's words in it, the templates it has enough words of, places of their words, base places."""
    vocabulary = sorted({x for t in templates for x in t.distinct} | {x for p, _ in base for x in p.split()})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumn("present", F.array_intersect(_texts(vocabulary), "w"))
    enough = [F.when(F.size(F.array_intersect(_texts(t.distinct), "present")) >= t.need, F.lit(i)) for i, t in enumerate(templates)]
    rows = rows.withColumn("may", F.array_compact(F.array(*enough)) if enough else F.array().cast("array<int>"))
    own = F.array_intersect("present", F.flatten(F.transform("may", lambda t: F.element_at(F.array(*(_texts(t.distinct) for t in templates)), t + 1)))) if templates else _texts([])
    rows = rows.withColumn("own", F.when(F.size("may") > 0, own))
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.cast("int").alias("at"), x.alias("x"))), lambda h: F.array_contains("own", h["x"]))
    base_places = [_phrase_places(F.col("w"), F.col("present"), p.split(), i) for i, (p, _) in enumerate(base)]
    return rows.select(
        "row", "doc_id", F.size("w").cast("long").alias("n_words"), "present", "may", F.when(F.size("may") > 0, places).alias("places"),
        F.flatten(F.array(*base_places)).alias("base") if base_places else F.array().cast("array<struct<b:int,at:int>>").alias("base"),
    )


def votes(found: DataFrame, templates: list[Template], agree: int) -> DataFrame:
    """row, t, d (where the template would begin), q (place in the template), x (the word) and whether x is looked up."""
    spark = found.sparkSession
    # a row per word of the vocabulary, which the templates bound
    df = {r["x"]: r["n"] for r in found.select(F.explode("present").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}
    postings = [(i, x, q) for i, t in enumerate(templates) for q, x in enumerate(t.words)]
    by_rarity = F.array(*(_texts(sorted(t.distinct, key=lambda x: (df.get(x, 0), x))) for t in templates))
    spare = F.array(*(F.lit(min(agree, t.need) - t.need) for t in templates))
    one = found.where(F.size("may") > 0).select("row", F.explode("may").alias("t"), "present", "places")
    one = one.withColumn("known", F.array_intersect(F.element_at(by_rarity, F.col("t") + 1), "present"))
    one = one.withColumn("rare", F.slice("known", F.lit(1), F.size("known") + F.element_at(spare, F.col("t") + 1)))
    each = one.select("row", "t", "rare", F.inline("places")).join(F.broadcast(spark.createDataFrame(postings, "t int, x string, q int")), ["t", "x"])
    return each.select("row", "t", (F.col("at") - F.col("q")).alias("d"), "q", "x", F.array_contains("rare", F.col("x")).alias("rare"))


def stretches(cast: DataFrame, templates: list[Template], agree: int, gap: int) -> DataFrame:
    """row, t, d and the number of distinct words of each stretch that has enough of them and the key phrase."""
    spark = cast.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, t.need, min(agree, t.need), t.key, t.key_words) for i, t in enumerate(templates)], "t int, need int, agree int, key int, key_words int"))
    by_place = Window.partitionBy("row", "t").orderBy("d")
    ahead, around = by_place.rangeBetween(0, gap), by_place.rangeBetween(-gap, gap)
    rows = cast.join(known, "t")
    rows = rows.withColumn("centre", F.col("rare") & (F.size(F.collect_set(F.when(F.col("rare"), F.col("x"))).over(ahead)) >= F.col("agree")))
    rows = rows.withColumn("near", F.max("centre").over(around)).where("near")
    in_key = F.when((F.col("q") >= F.col("key")) & (F.col("q") < F.col("key") + F.col("key_words")), 1).otherwise(0)
    rows = rows.withColumn("whole", F.sum(in_key).over(Window.partitionBy("row", "t", "d")) == F.col("key_words"))
    rows = rows.withColumn("keyed", F.max("whole").over(ahead)).withColumn("n", F.size(F.collect_set("x").over(ahead)))
    return rows.where("keyed and n >= need").select("row", "t", "d", "n").distinct()


def scan(docs: DataFrame, *, least: float = 0.6, agree: int = 3, gap: int = 8, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``matches`` (label, place, score), the best of each template."""
    spark, all_of = docs.sparkSession, parsed(templates, least)
    found = runtime.stored(hits(docs, all_of, base), "hits")
    best = F.struct(F.col("n"), -F.col("d"))
    about = F.broadcast(spark.createDataFrame([(i, t.label, len(t.distinct)) for i, t in enumerate(all_of)], "t int, label string, words int"))
    each = stretches(votes(found, all_of, agree), all_of, agree, gap).groupBy("row", "t").agg(F.max("n").alias("n"), F.max_by("d", best).alias("d")).join(about, "t")
    each = each.select(F.col("row").alias("of"), F.struct("label", F.greatest("d", F.lit(0)).alias("at"), (F.col("n") / F.col("words")).alias("score")).alias("m"))
    matches = runtime.stored(each.groupBy("of").agg(F.array_sort(F.collect_list("m")).alias("m")), "matches")
    out = found.join(matches, found.row == matches["of"], "left").withColumn("matches", F.coalesce("m", F.array().cast(matches.schema["m"].dataType)))
    label_of = F.array(*(F.lit(x) for _, x in base))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: F.element_at(label_of, b["b"] + 1)))) if base else _texts([])
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("matches", lambda m: m["label"]))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)))
    at = F.transform("base", lambda b: b["at"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "matches",
    )


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan(runtime.table(spark, sf_dir, "documents")).drop("matches")


def oracle_op7(least: float = 0.6, gap: int = 8) -> str:
    """DuckDB SQL: every vote of every word, without looking up rare ones first."""
    quote = lambda x: "'" + x + "'"
    all_of = parsed(TEMPLATES, least)
    templates = ", ".join(f"({i}, {quote(t.label)}, {len(t.distinct)}, {t.need}, {t.key}, {t.key_words})" for i, t in enumerate(all_of))
    postings = ", ".join(f"({i}, {quote(x)}, {q})" for i, t in enumerate(all_of) for q, x in enumerate(t.words))
    base = " UNION ALL ".join(
        f"SELECT num, a.p AS pos, '{label}' AS label FROM placed a " + " ".join(f"JOIN placed w{k} USING (num)" for k in range(1, len(p.split()))) + f" WHERE a.x = '{p.split()[0]}'" + "".join(f" AND w{k}.p = a.p + {k} AND w{k}.x = '{x}'" for k, x in enumerate(p.split()) if k)
        for p, label in BASE
    )
    return f"""WITH docs AS (SELECT row_number() OVER () AS num, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
        t (t, label, words, need, key, key_words) AS (VALUES {templates}),
        posts (t, x, q) AS (VALUES {postings}),
        vocabulary AS (SELECT DISTINCT x FROM posts UNION SELECT unnest([{", ".join(quote(x) for p, _ in BASE for x in p.split())}])),
        placed AS MATERIALIZED (SELECT num, p, x FROM (SELECT num, unnest(w) AS x, unnest(range(len(w))) AS p FROM docs) SEMI JOIN vocabulary USING (x)),
        base AS MATERIALIZED ({base}),
        may AS MATERIALIZED (SELECT num, t FROM (SELECT DISTINCT num, x FROM placed) JOIN (SELECT DISTINCT t, x FROM posts) USING (x) JOIN t USING (t) GROUP BY num, t, need HAVING count(*) >= need),
        votes AS MATERIALIZED (SELECT num, t, p - q AS d, q, x FROM placed JOIN posts USING (x) JOIN may USING (num, t)),
        whole AS (SELECT num, t, d FROM votes JOIN t USING (t) WHERE q >= key AND q < key + key_words GROUP BY num, t, d, key_words HAVING count(*) = key_words),
        n AS (SELECT a.num, a.t, a.d, count(DISTINCT b.x) AS n FROM (SELECT DISTINCT num, t, d FROM votes) a JOIN votes b ON a.num = b.num AND a.t = b.t AND b.d BETWEEN a.d AND a.d + {gap} GROUP BY a.num, a.t, a.d),
        matched AS (SELECT n.num, t.label, n.n / t.words AS score FROM n JOIN t USING (t) WHERE n.n >= t.need AND EXISTS (SELECT 1 FROM whole k WHERE k.num = n.num AND k.t = n.t AND k.d BETWEEN n.d AND n.d + {gap})),
        b AS (SELECT num, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY num),
        l AS (SELECT num, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT num, label, score FROM matched UNION ALL SELECT num, label, 1.0 FROM base) GROUP BY num)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM docs LEFT JOIN b USING (num) LEFT JOIN l USING (num)"""
