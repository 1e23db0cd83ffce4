"""Questions against the vocabulary of values, many questions at once.

The dictionary has the folded words of each value as one phrase. A question is
its runs of words, which are joined with the phrases by equality; nothing is
searched in anything, and neither side is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.places import work_dir

DOC = "document_id"
#: Words of a value that a question can spell out, at most.
LONGEST = 8


def dictionary(values: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(phrase, n_words, concept, literal_value, is_state) of text and state values."""
    own = values.where(F.col("value_type").isin("text", "state")).groupBy("concept", "literal_value").agg(F.bool_or(F.col("value_type") == "state").alias("is_state"))
    split = own.withColumn("w", F.array_remove(F.split("literal_value", r"[^\p{L}\p{N}]+"), ""))
    n = F.size("w")
    return split.where(n.between(1, longest)).select(F.array_join("w", " ").alias("phrase"), n.alias("n_words"), "concept", "literal_value", "is_state")


def runs(questions: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(question_id, begin, end, phrase, before): every run of at most ``longest`` words of ``questions`` (question_id, text), and the word before it."""
    split = questions.select("question_id", words("text").alias("w")).where(F.size("w") > 0)
    each = split.select("question_id", "w", F.posexplode("w").alias("begin", "first"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("begin")))
    return each.select("question_id", "w", "begin", F.explode(lengths).alias("n")).select("question_id", "begin", (F.col("begin") + F.col("n")).alias("end"), F.array_join(F.slice("w", F.col("begin") + 1, F.col("n")), " ").alias("phrase"), F.get("w", F.col("begin") - 1).alias("before"))


def mentioned(questions: DataFrame, values: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(question_id, begin, end, phrase, concept, literal_value, is_state): values that questions spell out."""
    return runs(questions, longest).drop("before").join(dictionary(values, longest).drop("n_words"), "phrase")


def covered(spans: DataFrame) -> DataFrame:
    """Of a question's spans those that lie in no longer one; spans that merely overlap stay."""
    places = spans.select("question_id", "begin", "end").distinct()
    before = Window.partitionBy("question_id").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = places.withColumn("__reach", F.max("end").over(before)).where(F.col("__reach").isNull() | (F.col("end") > F.col("__reach"))).drop("__reach")
    return spans.join(kept, ["question_id", "begin", "end"], "left_semi")


def pinned(questions: DataFrame, values: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(question_id, document_id, score, n_anchors, n_tied): the document that each question describes.

    Its anchors are the longest phrases of the question that are values; a
    document scores 1001 for each that it states in any field, plus their words.
    With several best documents none is pinned and ``n_tied`` says how many
    there are; a question without anchors has no row. Questions with the same
    anchors are answered together.

    Only documents that state the rarest anchor are scored. The best of all are
    they or the best for the other anchors: a document with the rarest one scores
    more than it does for the others. So the others are asked in turn, where they
    could still reach the score, once for all sets that end alike.
    """
    spark, root = values.sparkSession, work_dir(values.sparkSession, "pinned")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    spans = covered(mentioned(questions, values, longest)).select("question_id", "phrase").distinct()
    sets = written(spans.groupBy("question_id").agg(F.array_sort(F.collect_list("phrase")).alias("anchors")), "sets")
    phrases = sets.select(F.explode("anchors").alias("phrase")).distinct()
    meaning = dictionary(values, longest).select("phrase", "concept", "literal_value").join(phrases, "phrase", "left_semi")
    stated = written(values.select(DOC, "concept", "literal_value").join(meaning, ["concept", "literal_value"]).select("phrase", DOC).distinct(), "stated")
    known = written(stated.groupBy("phrase").agg(F.count("*").alias("n"), F.min(DOC).alias(DOC)), "known")

    asked = sets.select("anchors").distinct()
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "phrase")))
    each = asked.select("anchors", F.explode("anchors").alias("phrase")).join(known.select("phrase", "n"), "phrase", "left")
    left = each.groupBy("anchors").agg(ranked.alias("r")).select("anchors", F.col("r.phrase").alias("rest"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("n_tied"), F.lit(None).cast(values.schema[DOC].dataType).alias(DOC))
    done, turn = [], 0
    left = written(left, "left0")
    while not left.isEmpty():
        best = _best_of_rarest(left.select("rest").distinct(), stated, known)
        score, more = F.coalesce("b.score", F.lit(0)), F.coalesce("b.n_tied", F.lit(0))
        ahead, level = score > F.col("score"), score == F.col("score")
        n_tied = F.when(ahead, more).when(level, F.col("n_tied") + more).otherwise(F.col("n_tied"))
        first = F.when(ahead | level & (F.col("n_tied") == 0), F.col(f"b.{DOC}")).otherwise(F.col(DOC))
        found = left.join(best, "rest", "left").select("anchors", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), F.greatest(score, "score").alias("score"), n_tied.alias("n_tied"), first.alias(DOC))
        turn += 1
        found = written(found, f"found{turn}")
        reach = (F.size("rest") > 0) & (F.col("score") <= _weight(F.col("rest")))
        done.append(found.where(~reach & (F.col("score") > 0)))
        left = found.where(reach)
    if not done:
        done = [left]
    one = reduce(DataFrame.unionByName, done).select("anchors", F.when(F.col("n_tied") == 1, F.col(DOC)).alias(DOC), "score", F.size("anchors").alias("n_anchors"), "n_tied")
    return sets.join(one, "anchors").select("question_id", DOC, "score", "n_anchors", "n_tied")


def _weight(phrases: Column) -> Column:
    """1001 for each phrase, plus their words."""
    words_of = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "))) + 1
    return F.aggregate(phrases, F.lit(0).cast("long"), lambda total, p: total + 1001 + words_of(p))


def _best_of_rarest(sets: DataFrame, stated: DataFrame, known: DataFrame) -> DataFrame:
    """(rest, b: score, n_tied, document_id): of the documents that state the first phrase of ``rest`` those with the best score for all of it; ``known`` has them already where it is the only phrase."""
    first = F.element_at("rest", 1)
    alone = sets.where(F.size("rest") == 1).withColumn("phrase", first).join(known, "phrase")
    alone = alone.select("rest", F.struct(_weight(F.col("rest")).alias("score"), F.col("n").alias("n_tied"), F.col(DOC)).alias("b"))
    having = sets.where(F.size("rest") > 1).withColumn("phrase", first).join(stated, "phrase").select("rest", DOC)
    hits = having.join(stated, DOC).where(F.array_contains("rest", F.col("phrase")))
    scores = hits.groupBy("rest", DOC).agg(F.sum(_weight(F.array("phrase"))).alias("score"))
    # Documents of equal score are counted, not gathered.
    levels = scores.groupBy("rest", "score").agg(F.count("*").alias("n_tied"), F.min(DOC).alias(DOC))
    several = levels.groupBy("rest").agg(F.max_by(F.struct("score", "n_tied", DOC), "score").alias("b"))
    return alone.unionByName(several)


def field_names(values: DataFrame) -> DataFrame:
    """(phrase, concept, is_binary): the fields' names as phrases, and whether a field's values are yes and no, both and nothing else."""
    yes, no = F.col("literal_value") == "si", F.col("literal_value") == "no"
    every = values.groupBy("concept").agg((F.bool_and(yes | no) & F.bool_or(yes) & F.bool_or(no)).alias("b"))
    return every.select(F.array_join(words("concept"), " ").alias("phrase"), "concept", F.coalesce("b", F.lit(False)).alias("is_binary"))


def inferred_filters(questions: DataFrame, values: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(question_id, concept, literal_value, how): what questions ask of documents in plain words, one row a field and value.

    explicit: the question says the value and names its field. implicit: it says
    the value alone, which is a state or has several words, and one field has
    it; ambiguous: several have it, and a row stands for each. binary: it names
    a field of yes and no, which is no after `sin` or `no`. A field that is
    named without a value is what the question asks for if no field is named
    before it (asked), else a condition that could not be applied (unapplied);
    both have no value. A value inside the name of a field is part of the name.
    Questions that are null or say nothing of this have no rows; repeated
    questions of one id are one question.

    Fields and values are one dictionary, which is joined once; all else goes by
    question, whose phrases are as many as its words allow. Questions of one
    wording are answered together: their ids wait until the answer is there.
    """
    asked = questions.where("text is not null").groupBy("question_id").agg(F.array_sort(F.collect_set("text")).alias("wording"))
    wordings = asked.select("wording").distinct()
    told = _told(wordings.select(F.col("wording").alias("question_id"), F.explode("wording").alias("text")), values, longest)
    return asked.join(told.withColumnRenamed("question_id", "wording"), "wording").select("question_id", "concept", "literal_value", "how")


def _told(questions: DataFrame, values: DataFrame, longest: int) -> DataFrame:
    """``inferred_filters`` of different questions."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    names = field_names(values).select("phrase", "concept", none.alias("literal_value"), no.alias("is_state"), "is_binary", F.lit(True).alias("is_field"))
    known = names.unionByName(dictionary(values, longest).drop("n_words").withColumns({"is_binary": no, "is_field": no}))
    spans = runs(questions, longest).join(known, "phrase").repartition("question_id")
    meant = F.collect_set(F.struct("concept", "literal_value", "is_state", "is_binary"))
    places = spans.groupBy("question_id", "is_field", "begin", "end").agg(meant.alias("meant"), F.min("before").alias("before"))

    field, begin, end = F.col("is_field"), F.col("begin"), F.col("end")
    question = Window.partitionBy("question_id")
    longer = Window.partitionBy("question_id", "is_field").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = places.withColumn("reach", F.max("end").over(longer)).where(F.col("reach").isNull() | (end > F.col("reach")))
    here = question.orderBy("begin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.withColumn("reach", F.max(F.when(field, end)).over(here)).where(field | F.col("reach").isNull() | (end > F.col("reach")))
    said = kept.withColumns({"named": F.flatten(F.collect_list(F.when(field, F.col("meant.concept"))).over(question)), "first": F.min(F.when(field, begin)).over(question)})
    said = said.withColumn("own", F.when(~field, F.filter("meant", lambda m: F.array_contains("named", m["concept"]))))
    said = said.withColumn("told", F.flatten(F.collect_list(F.col("own.concept")).over(question)))

    row = lambda m, literal, how: F.struct(m["concept"].alias("concept"), literal.alias("literal_value"), how.alias("how"))
    telling = F.filter("meant", lambda m: m["is_state"] | (end - begin > 1))
    several = F.when(F.size(F.array_distinct(telling["concept"])) == 1, F.lit("implicit")).otherwise(F.lit("ambiguous"))
    alone = F.transform(telling, lambda m: row(m, m["literal_value"], several))
    explicit = F.transform("own", lambda m: row(m, m["literal_value"], F.lit("explicit")))
    denied = F.coalesce(F.col("before").isin("sin", "no"), no)
    yes_no = F.when(denied, F.lit("no")).otherwise(F.lit("si"))
    missing = F.when(begin == F.col("first"), F.lit("asked")).otherwise(F.lit("unapplied"))
    bare = F.filter("meant", lambda m: ~F.array_contains("told", m["concept"]))
    lost = F.transform(bare, lambda m: row(m, F.when(m["is_binary"], yes_no), F.when(m["is_binary"], F.lit("binary")).otherwise(missing)))
    found = said.select("question_id", "is_field", "begin", F.explode(F.when(field, lost).when(F.size("own") > 0, explicit).otherwise(alone)).alias("r"))
    # A field that is named again counts where it comes first, and a value that is said again once.
    once = found.groupBy("question_id", "r.concept", "is_field", F.when(~field, F.col("r.literal_value")).alias("literal")).agg(F.min_by("r", "begin").alias("r"))
    return once.select("question_id", "r.concept", "r.literal_value", "r.how")
