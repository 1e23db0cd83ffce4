"""Exact aggregation with an account of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.values import exact_amount, exact_mean, exact_product, exact_ratio

DOC = "document_id"
NO_LABEL = "Sin valor"
NUMERIC = ("money", "number", "percentage")


def operands(values: DataFrame, concept: str, scope: DataFrame | None = None) -> DataFrame:
    rows = values.where(F.col("concept") == concept)
    return rows.join(scope.select(DOC), DOC, "left_semi") if scope is not None else rows


def operation(op: str) -> Column:
    total, n = F.sum("numeric"), F.count("numeric")
    return {
        "sum": total.cast("decimal(38,4)"),
        "count": F.count("*").cast("decimal(38,4)"),
        "min": F.min("numeric").cast("decimal(38,4)"),
        "max": F.max("numeric").cast("decimal(38,4)"),
        "average": exact_mean(total, n).cast("decimal(38,4)"),
    }[op]


def compute(rows: DataFrame, op: str, groups: list[str] = ()) -> DataFrame:
    """One row for each group and currency, in order; counting ignores the currency and needs no number."""
    keys = [*groups] if op == "count" else [*groups, "currency"]
    kept = rows if op == "count" else rows.where("numeric is not null")
    out = kept.groupBy(*keys).agg(operation(op).alias("value"), F.count("*").alias("n_values"), F.count_distinct(DOC).alias("n_documents"), F.bool_and("reliable").alias("reliable"))
    return out.orderBy(*keys) if keys else out


def aggregate(values: DataFrame, scope: DataFrame, concept: str, op: str = "sum", currency: str | None = None) -> DataFrame:
    """Totals by currency, with the scope's documents accounted for: calculated, missing, invalid, other currency."""
    own = values.where(F.col("concept") == concept)
    fits = F.lit(True) if currency is None else F.coalesce(F.upper("currency") == currency.upper(), F.lit(False))
    state = own.groupBy(DOC).agg(F.max((F.col("numeric").isNotNull() & fits).cast("int")).alias("used"), F.max((F.col("numeric").isNotNull() & ~fits).cast("int")).alias("other"), F.bool_and("reliable").alias("reliable"))
    seen = scope.select(DOC).join(state, DOC, "left")
    account = seen.agg(
        F.count("*").alias("n_scope"),
        F.count_if(F.expr("used = 1")).alias("n_calculated"),
        F.count_if(F.expr("used is null")).alias("n_missing"),
        F.count_if(F.expr("used = 0 and other = 1")).alias("n_currency"),
        F.count_if(F.expr("used = 0 and other = 0")).alias("n_invalid"),
        F.coalesce(F.bool_and("reliable"), F.lit(True)).alias("all_reliable"),
    )
    rows = own.join(scope.select(DOC), DOC, "left_semi").where(fits & F.col("numeric").isNotNull())
    totals = rows.groupBy("currency").agg(operation(op).alias("value"))
    whole = F.col("all_reliable") & (F.col("n_calculated") == F.col("n_scope"))
    every = account.join(F.broadcast(totals), F.lit(True), "left")  # the account is one row and stays without totals; they are one a currency
    return every.withColumn("verified", whole).select("currency", "value", "n_scope", "n_calculated", "n_missing", "n_currency", "n_invalid", "verified")


def labelled(rows: DataFrame, labels: DataFrame, name: str = "grp") -> DataFrame:
    """Each operand with its group labels: once with each different label that is its own, or with NO_LABEL.

    An operand of a record has the labels of that same record and no others; an
    operand outside of records has all labels of its document.
    """
    own = labels.select(F.col(DOC).alias("__doc"), F.col("record_scope").alias("__scope"), F.col("text_value").alias(name))
    in_record = own.where("__scope is not null").distinct()
    of_document = own.select("__doc", name).distinct()
    same = F.col(DOC) == F.col("__doc")
    tabular = rows.where("record_scope is not null").join(in_record, same & (F.col("record_scope") == F.col("__scope")), "left").drop("__doc", "__scope")
    others = rows.where("record_scope is null").join(of_document, same, "left").drop("__doc")
    return tabular.unionByName(others).withColumn(name, F.coalesce(name, F.lit(NO_LABEL)))


def compute_category(values: DataFrame, scope: DataFrame, kind: str, op: str = "sum") -> DataFrame:
    """Any field of the kind; a document counts only if it has exactly one such value.

    Values and scope meet by document in one pass, where a join would sort both
    again; account and totals come from the few rows of its result. The values
    of one currency are counted by hash before a document's currencies meet.
    """
    own = values.where(F.col("value_type") == kind).select(DOC, "numeric", "currency", "reliable", F.lit(1).alias("n"), F.lit(0).alias("__seen"))
    every = own.unionByName(scope.select(DOC, F.lit(0).alias("n"), F.lit(1).alias("__seen")), allowMissingColumns=True)
    parts = [F.sum("n").alias("n"), F.sum("__seen").alias("__seen"), F.max("numeric").alias("numeric"), F.bool_and("reliable").alias("reliable")]
    each = every.groupBy(DOC, "currency").agg(*parts).groupBy(DOC).agg(*parts, F.max("currency").alias("currency"))
    seen = each.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("__seen").cast("int"))).alias("__time", "__0"))
    n, by_currency = F.col("n"), op != "count"
    fits = (n == 1) & (F.col("numeric").isNotNull() | F.lit(not by_currency))
    groups = seen.groupBy(F.least(n, F.lit(2)).alias("k"), fits.alias("fits"), F.when(fits & F.lit(by_currency), F.col("currency")).alias("currency"))
    few = groups.agg(operation(op).alias("value"), F.count("*").alias("n_values"), F.count_if(F.col("__time") == 0).alias("n_documents"), F.bool_and("reliable").alias("reliable"))
    counted = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n_values"))), F.lit(0).cast("long"))
    k, total = F.col("k"), ["currency"] * by_currency + ["value", "n_values", "n_documents", "reliable"]
    account = few.agg(counted(F.lit(True)).alias("n_scope"), counted(k == 0).alias("n_none"), counted(k == 2).alias("n_several"), counted(k == 1).alias("n_calculated"), F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct(*total)))).alias("t"))
    out = account.select("n_scope", "n_none", "n_several", "n_calculated", F.explode_outer("t").alias("t")).select("*", "t.*").drop("t")
    return out if by_currency else out.na.fill(0, ["n_values", "n_documents"]).withColumn("value", F.coalesce("value", F.lit(0)).cast("decimal(38,4)"))


def record_number(scope: str = "record_scope") -> Column:
    """The number in a record's name, by which records are in order: `fila 10` comes after `fila 2`."""
    return F.regexp_extract(scope, r"\d+", 0).try_cast("long")


def first_value(values: DataFrame, concept: str) -> DataFrame:
    """The first value of a field in each document; records by number."""
    order = F.struct("ordinal", record_number(), "record_scope", "text_value")
    return values.where(F.col("concept") == concept).groupBy(DOC).agg(F.min_by(F.struct("numeric", "currency", "value_type", "reliable"), order).alias("__v")).select(DOC, "__v.*")


def row_operation(values: DataFrame, left: str, right: str, op: str) -> DataFrame:
    """left op right within each document: each left value with the first right one.

    Differences need one unit; a product takes at most one currency; a quotient
    of one currency has none. ``issue`` says why there is no result.
    """
    a = values.where(F.col("concept") == left).select(DOC, "record_scope", F.col("numeric").alias("l"), F.col("currency").alias("lc"))
    b = first_value(values, right).select(DOC, F.col("numeric").alias("r"), F.col("currency").alias("rc"))
    rows = a.join(b, DOC)
    same = F.col("lc").eqNullSafe(F.col("rc"))
    one = F.col("lc").isNull() | F.col("rc").isNull()
    wide = "decimal(38,4)"
    fits, value, unit = {
        "subtract": (same, (F.col("l") - F.col("r")).cast(wide), F.col("lc")),
        "multiply": (one, exact_product(F.col("l"), F.col("r")), F.coalesce("lc", "rc")),
        "divide": (same | F.col("rc").isNull(), exact_ratio(F.col("l"), F.col("r")).cast(wide), F.when(F.col("rc").isNull(), F.col("lc"))),
    }[op]
    issue = F.when(F.col("l").isNull() | F.col("r").isNull(), "invalid").when(~fits, "incompatible").when((F.col("r") == 0) & F.lit(op == "divide"), "zero_divisor")
    issue = F.coalesce(issue, F.when(value.isNull(), "out_of_range"))
    return rows.withColumn("issue", issue).withColumn("result", F.when(F.col("issue").isNull(), value)).withColumn("unit", F.when(F.col("issue").isNull(), unit))


def row_totals(rows: DataFrame) -> DataFrame:
    """Sum of the documents' results by unit, and the issues."""
    return rows.groupBy("unit", "issue").agg(F.sum("result").cast("decimal(38,4)").alias("total"), F.count("*").alias("n_rows"), F.count_distinct(DOC).alias("n_documents"))


def catalogue(values: DataFrame) -> DataFrame:
    """Fields with their majority kind and how often they occur."""
    votes = values.groupBy("concept", "value_type").agg(F.count("*").alias("n"))
    return votes.groupBy("concept").agg(F.sum("n").alias("n_values"), F.max_by("value_type", F.struct("n", -kind_rank(F.col("value_type")))).alias("kind"))


def kind_rank(kind: Column) -> Column:
    from ..functions.values import KIND_ORDER

    return F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind)


def distinct_values(values: DataFrame, concept: str, most: int = 200) -> DataFrame:
    return values.where(F.col("concept") == concept).select("text_value").distinct().orderBy("text_value").limit(most)


def signs(values: DataFrame) -> DataFrame:
    """Numbers and negatives of each field, and whether a negative there is an anomaly."""
    out = values.where("numeric is not null").groupBy("concept").agg(F.count("*").alias("n_numeric"), F.count_if(F.expr("numeric < 0")).alias("n_negative"))
    return out.withColumn("negative_is_odd", (F.col("n_numeric") >= 20) & (F.col("n_negative") * 20 <= F.col("n_numeric")))


def summary(rows: DataFrame) -> DataFrame:
    """Smallest, largest and total by kind and currency; percentages are not added up."""
    total = F.sum("numeric").cast("decimal(38,4)")
    return rows.where("numeric is not null").groupBy("value_type", "currency").agg(F.min("numeric").alias("low"), F.max("numeric").alias("high"), F.when(F.col("value_type") != "percentage", total).alias("total"), F.count("*").alias("n"))


def value_list(rows: DataFrame, shown: int = 10) -> DataFrame:
    """The first literal values, and how many more there are."""
    each = rows.groupBy("literal_value").agg(F.count("*").alias("n"))
    more = each.agg((F.greatest(F.count("*") - shown, F.lit(0))).alias("n_more"))
    return each.orderBy("literal_value").limit(shown).crossJoin(F.broadcast(more))


def fields_across(rows: DataFrame) -> DataFrame:
    """Fields that agree in all documents read, and those that differ.

    One pass: a document counts for a field with the field's first value in it, and for the reading with its first field.
    """
    own = rows.groupBy(DOC, "concept").agg(F.sort_array(F.collect_set("literal_value")).alias("__values"))
    led = own.withColumn("__lead", (F.row_number().over(Window.partitionBy(DOC).orderBy("concept")) == 1).cast("int"))
    each = led.select("concept", "__lead", F.posexplode_outer("__values").alias("__at", "literal_value"))
    first = F.coalesce(F.col("__at"), F.lit(0)) == 0
    counted = each.groupBy("concept", "literal_value").agg(F.count_if(first).alias("n"), F.sum(F.when(first, F.col("__lead")).otherwise(0)).alias("__led"))
    fields = counted.groupBy("concept").agg(F.sum("n").alias("n_documents"), F.count("literal_value").alias("n_distinct"), F.sum("__led").alias("__led"))
    # The fields' table is as small as the catalogue; its window has one row a field.
    read = fields.withColumn("n_read", F.sum("__led").over(Window.partitionBy())).drop("__led")
    return read.withColumn("common", (F.col("n_distinct") == 1) & (F.col("n_documents") == F.col("n_read")))


def agreed_value(values: DataFrame, scope: DataFrame, concept: str) -> DataFrame:
    """One row: documents in scope, those that state the field, its different values, and the one all agree on.

    ``principal`` is the smallest document that states it. ``outcome`` is
    absent, agreed or differing.
    """
    own = values.where(F.col("concept") == concept).join(scope.select(DOC), DOC, "left_semi")
    stated = own.agg(F.count_distinct(DOC).alias("n_documents"), F.count_distinct("literal_value").alias("n_values"), F.min(DOC).alias("principal"), F.min("text_value").alias("__value"), F.coalesce(F.bool_and("reliable"), F.lit(True)).alias("reliable"))
    outcome = F.when(F.col("n_values") == 0, "absent").when(F.col("n_values") == 1, "agreed").otherwise("differing")
    return stated.select("n_documents", "n_values", "principal", F.when(F.col("n_values") == 1, F.col("__value")).alias("value"), outcome.alias("outcome"), "reliable")


def in_labelled_rows(values: DataFrame, label: str, concept: str) -> DataFrame:
    """Values of a field in the records that hold a cell equal to the label."""
    rows = values.where((F.col("literal_value") == fold(label)) & F.col("record_scope").isNotNull()).select(DOC, "record_scope").distinct()
    return values.where(F.col("concept") == concept).join(rows, [DOC, "record_scope"], "left_semi")


def operand(values: DataFrame, concept: str) -> DataFrame:
    """Each document's operand: its number if it states one, else why not: no number, or several.

    A measure such as `12 kg` counts by its number.
    """
    number = F.coalesce("numeric", exact_amount(F.regexp_extract("text_value", r"^\s*(-?[0-9][0-9,]*(?:\.[0-9]{1,4})?)\s+[^\d\s]+\s*$", 1)))
    each = values.where(F.col("concept") == concept).withColumn("__x", number).groupBy(DOC).agg(F.count_distinct("__x").alias("n"), F.min("__x").alias("__one"))
    issue = F.when(F.col("n") == 0, "operacion_indeterminada").when(F.col("n") > 1, "operando_multiple_en_documento")
    return each.select(DOC, F.when(F.col("n") == 1, F.col("__one")).alias("numeric"), issue.alias("issue"))


def sampled_citations(rows: DataFrame, bucket: str, most: int = 18) -> DataFrame:
    """Documents in turn from each bucket, the smallest ids first, so that a large bucket doesn't hide the others."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(DOC))
    ranked = rows.select(bucket, DOC).distinct().withColumn("turn", turn).where(F.col("turn") <= most)
    return ranked.orderBy("turn", bucket).limit(most)
