"""License scan of paragraphs.

A paragraph ends at a blank line; its wrapped lines are joined, and it is judged
sentence by sentence, so that a notice is found whatever stands around it. A
multinomial logistic regression on the word pairs and triples of the templates
tells licence families and an unknown class apart. Its known examples are the
templates with words left out; the unknown ones are sentences of the corpus that no
template resembles, each distinct set of n-grams once, all of them. Half of these
train; on the other half the probability that a family needs is set, so that one in a
thousand passes. What passes is confirmed by the share of a template's word pairs
that the sentence has.

DataFrame expressions and Spark ML only. Sentences without any of the words that every
template has one of could not be confirmed, and go before words are parted. Texts are
read twice: for the distinct n-gram sets, and for scoring. Only those sets and what was
confirmed are shuffled, both combined before they move.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.tables import stored

#: How licences are commonly declared.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-3-clause", "Released under the BSD License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/, under the Mozilla Public License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Every template has one of these; a sentence without any is in no family.
TELLING = r"(?i)licen[cs]|permission|redistribut|warrant|copyright|public domain"
UNKNOWN = "unknown"
_BLANK = r"\n[^\S\n]*\n\s*"
_SENTENCE = r"(?<=[.!?:;])[\"')\]]*\s+(?=[\"'(\[]*\p{Lu})"
_FEATURES = 1 << 13


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}+-]+"), "")


def _list(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def _runs(words: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by spaces."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def sentences_of(docs: DataFrame) -> DataFrame:
    """doc_id and words of every sentence that has a telling word."""
    text = F.col("text").cast("string")
    paragraphs = docs.where(text.rlike(TELLING)).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(text, _BLANK)).alias("paragraph"))
    joined = paragraphs.where(F.col("paragraph").rlike(TELLING))
    sentences = joined.select("doc_id", F.explode(F.split("paragraph", _SENTENCE)).alias("sentence"))
    return sentences.where(F.col("sentence").rlike(TELLING)).select("doc_id", words_of(F.col("sentence")).alias("words"))


class Templates:
    """The templates' n-grams, as literals of the plan."""

    def __init__(self, spark):
        rows = spark.createDataFrame(list(TEMPLATES), "family string, text string")
        self.rows = rows.select("family", words_of(F.col("text")).alias("words"))
        grams = self.rows.select("family", F.array_distinct(_runs(F.col("words"), 2)).alias("pairs"), _runs(F.col("words"), 3).alias("triples")).collect()
        self.pairs = [(r.family, r.pairs) for r in grams]
        self.grams = sorted({g for r in grams for g in (*r.pairs, *r.triples)})
        self.classes = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]

    def features(self, rows: DataFrame) -> DataFrame:
        """Adds ``grams``: the templates' pairs and triples that the words have."""
        own = F.concat(_runs(F.col("words"), 2), _runs(F.col("words"), 3))
        # A generator, as a filter would work them out anew for every template.
        return rows.select("*", F.explode(F.array(F.array_sort(F.array_intersect(own, _list(self.grams))))).alias("grams"))

    def covered(self, family: str | None = None) -> Column:
        """The largest share of a template's pairs among ``grams``; of the
        templates of ``family`` if given as a column."""
        shares = []
        for name, pairs in self.pairs:
            share = F.size(F.array_intersect("grams", _list(pairs))) / len(pairs)
            shares.append(F.when(F.col(family) == name, share).otherwise(0.0) if family else share)
        return F.greatest(*shares)

    def examples(self) -> DataFrame:
        """family and words: each template whole, without one of its words, and
        without up to three tenths of them at its beginning or end."""
        size = F.size("words")
        most = F.floor(size * 0.3).cast("int")
        kept = F.concat(
            F.transform(F.sequence(F.lit(0), size), lambda i: F.filter("words", lambda w, k: k + 1 != i)),
            F.transform(F.sequence(F.lit(0), most), lambda i: F.slice("words", i + 1, size - i)),
            F.transform(F.sequence(F.lit(0), most), lambda i: F.slice("words", F.lit(1), size - i)),
        )
        return self.rows.select("family", F.explode(kept).alias("words")).distinct()


def _vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=_FEATURES, binary=True).transform(rows)


def train_licenses(docs: DataFrame, templates: Templates, strange: float = 0.4) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the probability that a family needs. A sentence that has
    less than ``strange`` of every template's pairs is an unknown one."""
    spark = docs.sparkSession
    unknown = templates.features(sentences_of(docs)).where(templates.covered() < strange).select("grams").distinct()
    unknown = stored(unknown.withColumn("half", F.pmod(F.xxhash64("grams"), F.lit(2))), "unknown-sentences")
    number = F.array_position(F.lit(templates.classes), F.col("family")) - 1
    known = templates.features(templates.examples()).select(number.cast("double").alias("label"), "grams")
    nothing = spark.range(1).select(F.lit(0.0).alias("label"), F.array().cast("array<string>").alias("grams"))
    rows = stored(known.unionByName(unknown.where("half = 0").select(F.lit(0.0).alias("label"), "grams")).unionByName(nothing), "licence-examples")
    # Every class weighs the same, whatever the number of its examples.
    weights = [F.when(F.col("label") == r.label, 1.0 / r["count"]) for r in rows.groupBy("label").count().collect()]
    rows = _vectors(rows.withColumn("weight", F.coalesce(*weights))).select("label", "weight", "features")
    model = LogisticRegression(maxIter=40, regParam=0.0005, family="multinomial", weightCol="weight").fit(rows)
    likely = F.array_max(F.slice(vector_to_array("probability"), 2, len(templates.classes)))
    high = model.transform(_vectors(unknown.where("half = 1"))).agg(F.percentile_approx(likely, 0.999, 10_000)).first()[0]
    return model, max(0.5, high or 0.0)


def scan_licenses(docs: DataFrame, likeness: float = 0.7) -> DataFrame:
    """Of every document: doc_id, families (confirmed ones, sorted and joined by
    commas; empty: none), n_licensed (confirmed sentences), probability (the
    highest of these; null without one).

    A sentence has a family if that is its likeliest class, its probability reaches
    the calibrated threshold, and it has at least ``likeness`` of the word pairs of
    one of the family's templates, in any letter case and wrapped in any way. What
    licences share word for word counts for the family that the classifier names.

    Null or empty text: no sentences. A text without blank lines is one paragraph, one
    without sentence ends one sentence, of any length. Rows with one doc_id are one
    document; null doc_ids are one, too. Equal sentences of a document are each counted.
    Empty input: no rows. Other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    templates = Templates(docs.sparkSession)
    model, least = train_licenses(docs, templates)
    # What has too few pairs of every template cannot be confirmed and is not scored.
    near = templates.features(sentences_of(docs)).select("doc_id", "grams").where(templates.covered() >= likeness)
    scored = model.transform(_vectors(near)).select(
        "doc_id", "grams", F.element_at(F.lit(templates.classes), F.col("prediction").cast("int") + 1).alias("family"), F.array_max(vector_to_array("probability")).alias("p")
    )
    sure = scored.where((F.col("family") != UNKNOWN) & (F.col("p") >= least) & (templates.covered("family") >= likeness))
    found = sure.groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    found = found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("family")), ",").alias("families"),
        F.sum("n").alias("n_licensed"),
        F.max("p").alias("probability"),
    ).withColumnRenamed("doc_id", "found_id")
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), "probability"
    )
