"""License scans: a trained classifier of paragraphs, built of Spark's own expressions only.

Paragraphs are the lines of a text, and joined neighbouring lines between blank ones where a notice is wrapped over them:
of the rows of lines that hold ``overlap`` of a template's word pairs, the shortest, under the number of their
first line. Features are the words and word pairs that occur in the templates
of any family; a multinomial logistic regression with a small L2 penalty gives the probabilities of the families and of
``unknown``. It is trained on the templates, alone and set into paragraphs of the corpus, against
paragraphs of the corpus and fixed phrases that speak of licences without granting one. ``unknown`` is calibrated:
on all lines of the corpus that share no half of a template, the probability that all but one in
``1 / strictness`` stay under becomes the threshold, scores under 0.5 counting as 0.5. A prediction over the threshold is confirmed when
``overlap`` of the word pairs of one of the family's templates stand in the paragraph.

Few lines can hold enough of a template, or be scored over 0.5. ``anchors`` chooses words without one of which
neither is possible, from the templates and the weights of the model; only lines (and texts, for wrapped notices) with such a
word are cut into words and scored. That is a bound, so no result depends on it.

Everything runs on the JVM as narrow steps over the documents; training uses at most ``sample`` paragraphs, those with
the smallest hashes. A paragraph is scored whole, whatever its length.

Defined results: one row per paragraph that is predicted and confirmed; null and empty texts have no
paragraphs; equal rows give equal rows each; a null ``doc_id`` stays null; an empty table gives no rows (the model is then
trained on templates and phrases alone); other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrante.llm.common import stored

# Wording of public licence notices, by family.
TEMPLATES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3."],
    "All-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC0": ["To the extent possible under law, the author has dedicated all copyright to the public domain, CC0 1.0.", "Released under CC0 1.0 Universal."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
# Phrases with words of licences that grant none.
DECOYS = [
    "He renewed the driving license at the public office.",
    "The restaurant is licensed to sell wine in general.",
    "A copy of the software was released to the public.",
    "The rights of all persons are reserved for version two of the work.",
    "Use of this file is permitted by law.",
    "The Apache helicopter and the creative commons room.",
    "Students of MIT released a version under the general terms.",
]
UNKNOWN = "unknown"
_listed: dict[str, list[tuple[str, list[str], int]]] = {}


def words(text) -> F.Column:
    """Lower-case runs of letters, digits and bytes beyond ASCII, dots inside numbers included."""
    return F.expr(r"regexp_extract_all(lower(" + text + r"), '[0-9]+(?:\\.[0-9]+)*|[^\\x00-\\x60\\x7B-\\x7F]+', 0)")


def _once(rows: DataFrame, **columns) -> DataFrame:
    """``rows`` with more columns, computed once a row: as the output of a generator they are not put into the expressions that use
    them, as those of a projection are, where a lambda would compute them again for each element."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return rows.select("*", F.inline(F.array(made)))


def _with_terms(rows: DataFrame) -> DataFrame:
    rows = _once(rows, words=words("paragraph"))
    rows = NGram(n=2, inputCol="words", outputCol="_pairs").transform(rows)
    return _once(rows, pairs=F.col("_pairs")).drop("_pairs").withColumn("terms", F.concat("words", "pairs"))


def _with_held(rows: DataFrame) -> DataFrame:
    """``rows`` (with pairs) with ``held``: their word pairs that stand in any template, few as a rule."""
    listed = sorted({p for _, pairs, _ in _known(rows.sparkSession) for p in pairs})
    return _once(rows, held=F.array_intersect("pairs", F.array(*map(F.lit, listed))))


def templates(spark: SparkSession) -> DataFrame:
    """``(family, paragraph, words, pairs, terms)``."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return _with_terms(spark.createDataFrame(rows, "family string, paragraph string"))


def _known(spark: SparkSession) -> list[tuple[str, list[str], int]]:
    """``(family, distinct word pairs, number of words)`` of each of the fixed templates, cut into words once a session."""
    key = spark.sparkContext.applicationId
    if key not in _listed:
        rows = templates(spark).select("family", "pairs", "words").collect()  # fixed
        _listed[key] = [(r["family"], sorted(set(r["pairs"])), len(r["words"])) for r in rows]
    return _listed[key]


def best_overlap(spark: SparkSession, pairs: str, family: str | None = None) -> F.Column:
    """Largest share of a template's word pairs that stand in the column ``pairs``; of the templates of ``family`` only, if given."""
    known = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, own)).alias("pairs")) for f, own, _ in _known(spark)))
    if family:
        known = F.filter(known, lambda t: t["family"] == F.col(family))
    shares = F.transform(known, lambda t: F.size(F.array_intersect(F.col(pairs), t["pairs"])) / F.size(t["pairs"]))
    return F.when(F.size(pairs) > 0, F.coalesce(F.array_max(shares), F.lit(0.0))).otherwise(F.lit(0.0))


def anchors(families: list[list[tuple[float, str]]], limits: list[float], common: dict[str, int] | None = None) -> list[str]:
    """Words such that in each family (``(weight, term)`` of words and word pairs) the positive weights of the terms without any of
    them come to less than the family's limit, or all of its words. Those rare by ``common``, else long ones, are preferred."""
    chosen: set[str] = set()
    for terms, limit in zip(families, limits):
        left = [(weight, set(term.split(" "))) for weight, term in terms if weight > 0]
        while (left := [(w, own) for w, own in left if own.isdisjoint(chosen)]) and sum(w for w, _ in left) >= limit:
            gain: dict[str, float] = {}
            for weight, own in left:
                for word in own:
                    gain[word] = gain.get(word, 0.0) + weight
            cost = {word: 1 + common.get(word, 0) if common else 1 / len(word) ** 3 for word in gain}
            chosen.add(max(gain, key=lambda word: (gain[word] / cost[word], word)))
    return sorted(chosen)


def with_any(rows: DataFrame, text: str, chosen: list[str]) -> DataFrame:
    """``rows`` with ``able``: whether one of ``chosen`` stands in the column ``text``, also inside a word."""
    found = reduce(lambda a, b: a | b, [F.contains(F.col("_lowered"), F.lit(word)) for word in chosen], F.lit(False))
    return _once(rows, _lowered=F.lower(text)).withColumn("able", found).drop("_lowered")


def template_anchors(spark: SparkSession, overlap: float) -> list[str]:
    """Words without one of which no text holds ``overlap`` of the word pairs of a template."""
    listed = [pairs for _, pairs, _ in _known(spark)]
    return anchors([[(1.0, p) for p in own] for own in listed], [overlap * len(own) for own in listed])


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_no, paragraph)``: lines that are not blank, numbered among all lines of their text."""
    lines = docs.select(docs["doc_id"], F.split(docs["text"], "\n").alias("lines"))
    exploded = lines.select("doc_id", F.posexplode("lines").alias("paragraph_no", "paragraph"))
    return exploded.where(F.trim("paragraph") != "")


def wrapped(docs: DataFrame, overlap: float = 0.8) -> DataFrame:
    """``(doc_id, paragraph_no, paragraph, words, pairs, terms, shares)``: shortest rows of two or more neighbouring lines that hold ``overlap`` of
    the word pairs of a template, with the largest share of each family; ``paragraph_no`` is that of the first line.

    Rows of lines are only tried in blocks that hold as much as a whole, up to as many lines with words as the longest template has words.
    """
    spark = docs.sparkSession
    listed = _known(spark)
    longest = max(n for _, _, n in listed)
    known_words = template_anchors(spark, overlap)
    docs = with_any(docs.select(docs["doc_id"], docs["text"]), "text", known_words).where("able")
    # Lines of marks only (an empty line of a comment) part no block.
    numbered = docs.select(docs["doc_id"], F.expr(r"filter(transform(split(text, '\n'), (x, i) -> struct(i as no, x as line)), p -> trim(p.line) = '' or p.line rlike '[0-9A-Za-z\\x80-\\x{10FFFF}]')").alias("lines"))
    ends = F.expr("array_append(filter(transform(lines, (p, i) -> if(trim(p.line) = '', i, -1)), i -> i >= 0), size(lines))")
    # The blocks of a text are cut as one array, so that no row but the text's own holds all its lines.
    cut = "transform(ends, (e, k) -> slice(lines, if(k = 0, 0, ends[k - 1] + 1) + 1, e - if(k = 0, 0, ends[k - 1] + 1)))"
    blocks = _once(numbered, ends=ends).select("doc_id", F.explode(F.expr(f"filter({cut}, b -> size(b) >= 2)")).alias("lines"))
    blocks = _once(blocks, paragraph=F.expr("array_join(transform(lines, p -> p.line), ' ')"))
    blocks = _with_held(_with_terms(with_any(blocks, "paragraph", known_words).where("able")))
    blocks = blocks.where(best_overlap(spark, "held") >= overlap).select("doc_id", "lines")
    # A row keeps the lines that a notice can reach, not the block, and only where one of the words that each notice needs is in
    # reach. The shortest row of lines begins with one that adds a pair.
    needed = F.transform("lines", lambda p: reduce(lambda a, b: a | b, [F.contains(F.lower(p["line"]), F.lit(word)) for word in known_words], F.lit(False)))
    blocks = _once(blocks, needed=needed)
    starts = f"filter(sequence(0, size(lines) - 2), at -> array_contains(slice(needed, at + 1, {longest}), true))"
    near = f"transform({starts}, at -> struct(lines[at].no as paragraph_no, transform(slice(lines, at + 1, {longest}), p -> p.line) as lines))"
    rows = blocks.select("doc_id", F.inline(F.expr(near)))
    rows = _with_held(_with_terms(_once(rows, near=F.col("lines")).drop("lines").withColumn("paragraph", F.expr("near[0] || ' ' || near[1]"))))
    rows = rows.where(F.size("held") > 0).select("doc_id", "paragraph_no", "near", F.explode(F.expr("sequence(2, size(near))")).alias("size"))

    def shares(pairs: str) -> F.Column:
        known = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, own)).alias("pairs")) for f, own, _ in listed))
        return F.transform(known, lambda t: F.struct(t["family"].alias("family"), (F.size(F.array_intersect(F.col(pairs), t["pairs"])) / F.size(t["pairs"])).alias("share")))

    # The whole row first, as few of them hold enough.
    for name, part in (("own", "slice(near, 1, size)"), ("later", "slice(near, 2, size - 1)"), ("shorter", "slice(near, 1, size - 1)")):
        text = F.expr(f"array_join({part}, ' ')")
        if name == "own":
            rows = _with_held(_with_terms(rows.withColumn("paragraph", text)))
            rows = rows.where(best_overlap(spark, "held") >= overlap).withColumnRenamed("held", "h_own")
            rows = rows.withColumnsRenamed({c: f"own_{c}" for c in ("paragraph", "words", "pairs", "terms")})
        else:
            rows = _with_held(_with_terms(rows.withColumn("paragraph", text))).withColumnRenamed("held", f"h_{name}").drop("paragraph", "words", "pairs", "terms")
    rows = rows.withColumnsRenamed({f"own_{c}": c for c in ("paragraph", "words", "pairs", "terms")})
    rows = _once(rows, **{name: shares(f"h_{name}") for name in ("own", "later", "shorter")})
    enough = f"filter(arrays_zip(own, later, shorter), t -> t.own.share >= {overlap} and t.later.share < {overlap} and t.shorter.share < {overlap})"
    rows = rows.withColumn("shares", F.expr(f"transform({enough}, t -> t.own)")).where(F.size("shares") > 0)
    return rows.select("doc_id", "paragraph_no", "paragraph", "words", "pairs", "terms", "shares")


class LicenseModel:
    def __init__(self, vectorizer, classifier, labels: list[str], threshold: float) -> None:
        self.vectorizer, self.classifier, self.labels, self.threshold = vectorizer, classifier, labels, threshold

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with terms) with ``family``, the likeliest class but ``unknown``, and its ``probability``."""
        found = self.classifier.transform(self.vectorizer.transform(rows))
        p = F.slice(vector_to_array("probability"), 2, len(self.labels) - 1)  # unknown is the first class
        found = found.withColumn("_p", p).withColumn("score", F.array_max("_p"))
        names = F.array(*(F.lit(x) for x in self.labels[1:]))
        return found.withColumn("family", F.element_at(names, F.array_position("_p", F.col("score")).cast("int"))).drop("_p")


    def anchors(self, common: dict[str, int] | None = None) -> list[str]:
        """Words without one of which no family is likelier than ``unknown``, so that no score exceeds 0.5."""
        weights, bias = self.classifier.coefficientMatrix.toArray(), self.classifier.interceptVector.toArray()
        terms = self.vectorizer.vocabulary
        families = [[(float(w), t) for w, t in zip(own - weights[0], terms)] for own in weights[1:]]
        return anchors(families, [float(bias[0] - b) - 1e-6 for b in bias[1:]], common)


def train(docs: DataFrame, sample: int = 2000, strictness: float = 0.001) -> LicenseModel:
    spark = docs.sparkSession
    given = templates(spark)
    listed = given.select("family", "terms", "paragraph").collect()  # the fixed templates
    vocabulary = sorted({t for r in listed for t in r["terms"]})
    labels = [UNKNOWN, *TEMPLATES]
    # Bounded: the paragraphs with the smallest hashes, half of which are trained on.
    # The bound is found on the hashes alone, so no text is sorted or sent to one task.
    hashed = paragraphs(docs).select("paragraph", F.xxhash64("paragraph").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    drawn = hashed.where(F.col("h") <= F.lit(last).cast("long")).select("paragraph").distinct()
    drawn = stored(_with_terms(drawn.withColumn("n", F.xxhash64("paragraph", F.lit(1)))))
    plain = _with_held(drawn).where(best_overlap(spark, "held") < 0.5).drop("held")
    half = F.pmod("n", F.lit(2))

    names = F.array(*(F.lit(x) for x in labels))
    label = (F.array_position(names, F.col("family")) - 1).cast("double")
    count = len(listed)
    numbered = spark.createDataFrame([(k, r["family"], r["paragraph"]) for k, r in enumerate(listed)], "slot int, family string, notice string")
    hosts = plain.where(half == 0).select(F.pmod(F.xxhash64("paragraph", F.lit(2)), F.lit(count)).cast("int").alias("slot"), "paragraph")
    inside = hosts.join(F.broadcast(numbered), "slot").select("family", F.concat_ws(" ", "paragraph", "notice").alias("paragraph"))
    decoys = spark.createDataFrame([(UNKNOWN, d) for d in DECOYS], "family string, paragraph string")
    known = given.select("family", "paragraph")
    rows = known.unionByName(inside).unionByName(decoys).unionByName(plain.where(half == 0).select(F.lit(UNKNOWN).alias("family"), "paragraph"))
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, "terms", "features")
    vectorizer.setBinary(True)
    training = vectorizer.transform(_with_terms(rows)).select(label.alias("label"), "features").repartition(1)  # a bounded sample
    classes = F.greatest(F.lit(0.0), F.col("label"))
    sizes = training.groupBy(classes.alias("label")).agg(F.count("*").alias("size"))
    training = training.join(F.broadcast(sizes), "label").withColumn("weight", 1 / F.col("size"))
    classifier = LogisticRegression(family="multinomial", regParam=0.0002, maxIter=60, weightCol="weight", standardization=False).fit(training)
    model = LicenseModel(vectorizer, classifier, labels, 0.5)
    # All lines: those that may exceed 0.5 are scored, the others only counted. Scores are counted to a millionth first, so the
    # percentile sees a bounded number of rows.
    common = {r["word"]: r["n"] for r in plain.select(F.explode("words").alias("word")).groupBy("word").count().withColumnRenamed("count", "n").collect()}
    able = sorted({*model.anchors(common), *template_anchors(spark, 0.5)})
    lines = with_any(paragraphs(docs).select("paragraph"), "paragraph", able)
    every = _with_held(_with_terms(lines.select(F.when(F.col("able"), F.col("paragraph")).otherwise("").alias("paragraph"))))
    scores = model.scored(every.where(best_overlap(spark, "held") < 0.5)).select(F.greatest(F.round("score", 6), F.lit(0.5)).alias("score"))
    counted = scores.groupBy("score").agg(F.count("*").alias("n"))
    limits = counted.agg(F.percentile("score", F.lit(1 - strictness), F.col("n")).alias("limit")).first()
    model.threshold = max(0.5, limits["limit"] or 0.5)
    return model


def scan_licenses(docs: DataFrame, model: LicenseModel, overlap: float = 0.8) -> DataFrame:
    """``doc_id, paragraph_no, family, score, overlap`` of each paragraph with a confirmed licence."""
    # Most lines hold too little of any template, whatever the score.
    known_words = template_anchors(docs.sparkSession, overlap)
    texts = with_any(docs.select(docs["doc_id"], docs["text"]), "text", known_words).where("able")
    lines = with_any(paragraphs(texts), "paragraph", known_words).where("able")
    near = _with_held(_with_terms(lines)).where(best_overlap(docs.sparkSession, "held") >= overlap)
    found = model.scored(near).where(F.col("score") > model.threshold)
    found = found.withColumn("overlap", best_overlap(docs.sparkSession, "held", "family")).where(F.col("overlap") >= overlap)
    over = model.scored(wrapped(docs, overlap)).where(F.col("score") > model.threshold)
    over = over.withColumn("overlap", F.array_max(F.expr("transform(filter(shares, t -> t.family = family), t -> t.share)"))).where(F.col("overlap") >= overlap)
    both = found.select("doc_id", "paragraph_no", "family", "score", "overlap").unionByName(over.select("doc_id", "paragraph_no", "family", "score", "overlap"))
    return both.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "family", "score", "overlap")
