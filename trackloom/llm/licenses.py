"""Operator 4, licence scans by a trained paragraph classifier.

Paragraphs are lines, and two neighbouring lines together where a notice is wrapped from one to the next. Their words' unigrams and
bigrams, as far as a licence notice has them, are the sparse features of a multinomial logistic regression over licence families
and one unknown class. It is trained on notices alone, on notices inside paragraphs of the corpus, and on paragraphs of the corpus as
they are: a half of all its paragraphs, by a hash. The unknown class is calibrated on all of the other half: a family must lead it by
more than all but one in a thousand of them do. Paragraphs are counted by their features first, so equal sets are one weighted row. A prediction counts once a notice of the family confirms it, by the share of the notice's bigrams that the paragraph
has, and if no other family's notice fits clearly better. A paragraph may name several licences.

Paragraphs are scored where they are read, by built-in functions with the weights as constants: nothing is shuffled. Notices over
three lines or more, and wordings far from those below, are not found.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import dropped, stored
from trackloom.llm.fingerprints import let

#: All paragraphs learned from weigh as much together as so many notices; fewer weigh one each.
WEIGHT = 600
#: Margins of calibration are counted in steps of this width.
STEP = 0.001
#: Share of calibration paragraphs that may pass for a licence, and share of a notice's bigrams that confirms it.
PASSING, CONFIRMED = 0.001, 0.8
#: By so much less than the best one a notice may fit and still count.
BEHIND = 0.1

#: Usual wordings of each family's notice.
NOTICES = {
    "agpl": ("licensed under the gnu affero general public license", "gnu affero general public license version 3"),
    "apache": ("licensed under the apache license version 2 0", "released under the apache license 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the 3 clause bsd license"),
    "cc0": ("the author has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under cc0 1 0 universal"),
    "creative-commons": ("licensed under cc by nc 4 0", "licensed under cc by 4 0", "licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution license"),
    "epl": ("made available under the terms of the eclipse public license",),
    "gpl": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license", "gnu general public license version 2"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license version 2 1"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "mpl": ("subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "proprietary": ("all rights reserved", "all rights reserved no part may be reproduced without permission"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
FAMILIES = (*sorted(NOTICES), "unknown")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def vocabulary() -> list[str]:
    found = set()
    for notice in (n for many in NOTICES.values() for n in many):
        words = notice.split()
        found |= {*words, *map(" ".join, zip(words, words[1:]))}
    return sorted(found)


def bigrams_of(notice: str) -> list[str]:
    words = notice.split()
    return sorted(set(map(" ".join, zip(words, words[1:]))))


def paragraphs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, paragraph, text): the lines of texts that aren't blank, with their number."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "text"))
    return lines.filter(F.length(F.trim("text")) > 0)


def confirmed(found: Column, family: str) -> Column:
    """The largest share of the bigrams of one of the family's notices among `found`."""
    shares = [F.size(F.array_intersect(found, F.lit(b))) / F.lit(float(len(b))) for b in map(bigrams_of, NOTICES[family])]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def known_grams(words: Column, known: list[str]) -> Column:
    """The known ones among the words' unigrams and bigrams, each once. Only known words make pairs."""
    parts = sorted({w for g in known if " " in g for w in g.split()})
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.when(x.isin(parts) & y.isin(parts), F.concat_ws(" ", x, y)))
    return F.array_distinct(F.filter(F.concat(words, pairs), lambda g: g.isin(known)))


def features(text: Column, known: list[str]) -> Column:
    return let(words_of(text), lambda w: known_grams(w, known))


class Classifier:
    """Weights by n-gram and family, and how far a family must lead the unknown class."""

    def __init__(self, known: list[str], weights: list[list[float]], intercepts: list[float], lead: float):
        self.known, self.weights, self.intercepts, self.lead = known, weights, intercepts, lead

    def scores(self, found: Column) -> Column:
        """The logit of each family, from the features of a paragraph."""
        table = F.map_from_arrays(F.lit(self.known), F.array(*(F.lit(w) for w in self.weights)))
        return F.aggregate(found, F.lit(self.intercepts), lambda a, g: F.zip_with(a, table[g], lambda x, y: x + y))


def margin(scores: Column) -> Column:
    """By how much the best family leads the unknown class."""
    return F.array_max(F.slice(scores, 1, len(FAMILIES) - 1)) - F.get(scores, F.lit(len(FAMILIES) - 1))


def is_notice(found: Column) -> Column:
    """Whether some family's notice confirms what was found."""
    least = min(ceil(CONFIRMED * len(bigrams_of(n))) for many in NOTICES.values() for n in many)
    pairs = F.size(F.filter(found, lambda g: g.contains(" ")))  # with fewer, no notice can
    return (pairs >= least) & (F.greatest(*(confirmed(found, f) for f in sorted(NOTICES))) >= CONFIRMED)


def counted(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(apart, label, found, k): how many paragraphs of all documents that are no notices have the features `found`. Half of them are kept
    apart; the others count as they are, and once more with a notice after their first words."""
    known, unknown = vocabulary(), F.lit(len(FAMILIES) - 1)
    notices = [(FAMILIES.index(f), n) for f in sorted(NOTICES) for n in NOTICES[f]]
    part = F.pmod(F.xxhash64("text"), F.lit(2 * len(notices))).cast("int")
    label, notice = F.get(F.lit([i for i, _ in notices]), part), F.get(F.lit([n for _, n in notices]), part)
    inside = features(F.concat_ws(" ", F.substring_index("text", " ", 12), notice), known)

    def row(apart: bool, label: Column, found: Column) -> Column:
        return F.struct(F.lit(apart).alias("apart"), label.cast("int").alias("label"), F.array_sort(found).alias("found"))

    def rows(found: Column) -> Column:
        usual = F.when(part < len(notices), F.array(row(False, unknown, found), row(False, label, inside))).otherwise(F.array(row(True, unknown, found)))
        return F.when(~is_notice(found), usual)

    lines = paragraphs(documents, id_col, text_col)
    return lines.select(F.explode(let(features(F.col("text"), known), rows)).alias("x")).groupBy("x.apart", "x.label", "x.found").agg(F.count(F.lit(1)).alias("k"))


def passing(margins: DataFrame) -> float:
    """The least margin of margins(m, k) that at most PASSING of the k rows exceed, or one less than STEP above it."""
    steps = margins.groupBy(F.floor(F.col("m") / STEP).alias("step")).agg(F.max("m").alias("m"), F.sum("k").alias("k")).orderBy(F.desc("step")).collect()  # as many as margins have steps
    above, most = 0, PASSING * sum(r["k"] for r in steps)
    for r in steps:
        above += r["k"]
        if above > most:
            return r["m"]
    return 0.0


def trained(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    spark, known = documents.sparkSession, vocabulary()
    counts = stored(counted(documents, id_col, text_col))
    unknown = len(FAMILIES) - 1
    learned = counts.filter("not apart").agg(F.sum(F.when(F.col("label") == unknown, F.col("k")))).first()[0] or 0
    weight = F.col("k") * F.lit(min(1.0, WEIGHT / max(learned, 1)))
    corpus = counts.filter("not apart").select("label", "found", weight.cast("double").alias("weight"))
    notices = [(FAMILIES.index(f), n) for f in sorted(NOTICES) for n in NOTICES[f]]
    # parts of notices are no notices
    fixed = notices + [(unknown, w) for _, n in notices for w in n.split()]
    fixed = spark.createDataFrame(fixed, "label int, text string").coalesce(1).select("label", features(F.col("text"), known).alias("found"), F.lit(1.0).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary(known, "found", "features").transform(fixed.unionByName(corpus))
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=0.003, maxIter=40, standardization=False).fit(vectors.select("features", "weight", F.col("label").cast("double").alias("label")))
    by_family = model.coefficientMatrix.toArray()
    intercepts = model.interceptVector.toArray()
    classifier = Classifier(known, by_family.T.tolist(), intercepts.tolist(), 0.0)
    held = counts.filter("apart").select(let(classifier.scores(F.col("found")), margin).alias("m"), "k")
    classifier.lead = max(0.0, passing(held))
    dropped(counts)
    return classifier


def scanned(documents: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, score, confirmed, text): the paragraphs that are licence notices, by the classifier and its
    family's notices. score is the family's probability against all others. paragraph is the first line's number; text has two lines
    if the notice needs both.

    Null, empty and blank texts have no paragraphs; an empty table gives an empty result. Very long texts are scanned line by line like
    all others. Rows that repeat an id are scanned each; a null id is an id like any other. Further columns are ignored,
    whatever their names.
    """
    families, known = FAMILIES[:-1], classifier.known
    kind = "array<struct<family: string, score: double, confirmed: double>>"

    def described(line: Column) -> Column:
        return let(words_of(line), lambda w: F.struct(known_grams(w, known).alias("found"), F.get(w, F.lit(0)).alias("first"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), w), -1).alias("last")))

    def judged(found: Column) -> Column:
        def leading(scores: Column) -> Column:
            total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max(scores)))
            unknown = F.get(scores, F.lit(len(families)))

            def one(i: int, family: str) -> Column:
                score = F.get(scores, F.lit(i))
                return F.when(score - unknown > classifier.lead, F.struct(F.lit(family).alias("family"), (F.exp(score - F.array_max(scores)) / total).alias("score"), confirmed(found, family).alias("confirmed")))

            fit = F.filter(F.array(*(one(i, f) for i, f in enumerate(families))), lambda x: x.isNotNull() & (x["confirmed"] >= CONFIRMED))
            best = let(fit, lambda x: F.filter(x, lambda y: y["confirmed"] >= F.array_max(F.transform(x, lambda z: z["confirmed"])) - BEHIND))
            return F.when(margin(scores) > classifier.lead, best).otherwise(F.array().cast(kind))

        return F.when(F.size(found) > 1, let(classifier.scores(found), leading)).otherwise(F.array().cast(kind))

    def over_two(x: Column, y: Column) -> Column:
        """What two lines say together; nothing if one of them has no part in it."""
        between = F.array_intersect(F.array(F.concat_ws(" ", x["last"], y["first"])), F.lit(known))
        return F.when((F.size(x["found"]) > 0) & (F.size(y["found"]) > 0), judged(F.array_union(F.array_union(x["found"], y["found"]), between))).otherwise(F.array().cast(kind))

    rows = documents.select(F.col(id_col).alias("doc_id"), F.split(F.col(text_col), "\n").alias("lines"))
    rows = rows.select("doc_id", "lines", F.transform("lines", described).alias("said"))
    rows = rows.select("doc_id", "lines", "said", F.transform("said", lambda x: judged(x["found"])).alias("alone"))
    none = F.array().cast(kind)

    def new(x: Column, i: Column) -> Column:
        here, after = F.get("alone", i), F.coalesce(F.get("alone", i + 1), none)
        known_ = F.transform(F.concat(here, after), lambda z: z["family"])
        both = F.coalesce(over_two(x, F.get("said", i + 1)), none)
        two = F.filter(both, lambda z: ~F.array_contains(known_, z["family"]))
        line = F.get("lines", i)
        own = F.transform(here, lambda z: F.struct(i.cast("int").alias("paragraph"), z["family"].alias("family"), z["score"].alias("score"), z["confirmed"].alias("confirmed"), line.alias("text")))
        wrapped = F.transform(two, lambda z: F.struct(i.cast("int").alias("paragraph"), z["family"].alias("family"), z["score"].alias("score"), z["confirmed"].alias("confirmed"), F.concat_ws("\n", line, F.get("lines", i + 1)).alias("text")))
        return F.concat(own, wrapped)

    return rows.select("doc_id", F.explode(F.flatten(F.transform("said", new))).alias("x")).select("doc_id", "x.*")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(documents, trained(documents))
