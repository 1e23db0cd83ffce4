"""The engine's registered queries, each with the SQL that gives the same rows.

Keys begin with the operator's ID. Amounts leave as doubles, so that both
engines print them alike; inside, all arithmetic is exact.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import periods, text, values as val
from .operators import aggregate as agg
from .operators import relations as rel
from .operators import scope, search
from .sources.tables import Corpus, orders_corpus

FIRST, LAST = date(1996, 1, 1), date(1996, 6, 30)

# The same mapping of tables to documents and fields, in SQL.
KNOWN = """known as (select o_orderkey as id, o_orderstatus as estado, o_orderdate::date as fecha, o_totalprice::decimal(24,4) as importe, o_custkey, o_orderpriority as origin, c_mktsegment as segmento,
  n_name, (['MXN','USD','EUR','GBP','JPY'])[n_regionkey + 1] as currency
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
ITEMS = """items as (select l_orderkey as id, l_linenumber as linea, 'fila ' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as fila, l_quantity::decimal(24,4) as cantidad, l_extendedprice::decimal(24,4) as precio, l_discount::decimal(24,4) as descuento, l_returnflag as retorno, l_shipdate::date as envio, currency
  from lineitem join known on l_orderkey = id)"""
MEAN = "(sign(sum({x})) * ((2 * abs((sum({x}) * 10000)::hugeint) + count({x})) // (2 * count({x}))))::double / 10000"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the corpus; ``sql`` may use the CTEs known and items."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(orders_corpus(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"with {KNOWN}, {ITEMS}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


def table_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


# ---- filters and scopes ---------------------------------------------------------------------------


@query("F1_filter", "select id as document_id from known where estado = 'F' and segmento = 'BUILDING'")
def f1(c: Corpus):
    return scope.with_filters(c.documents, c.values, [("Estado", "F"), ("Segmento", "building")]).select("document_id")


@query("F2_origin", "select id as document_id from known where origin = '1-URGENT'")
def f2(c):
    return scope.from_origin(c.documents, "1-URGENT").select("document_id")


@query("F3_anchored_dates", "select id as document_id from known where fecha between date '1996-01-01' and date '1996-06-30'")
def f3(c):
    return scope.dated(c.documents, c.values, "Fecha", FIRST, LAST).select("document_id")


@query("F4_unanchored_dates", "select id as document_id from known k where (fecha >= date '1996-01-01' or exists (select 1 from items i where i.id = k.id and envio >= date '1996-01-01')) and (fecha <= date '1996-06-30' or exists (select 1 from items i where i.id = k.id and envio <= date '1996-06-30'))")
def f4(c):
    return scope.dated_anywhere(c.documents, c.values, FIRST, LAST).select("document_id")


@query("F5_scope", "select id as document_id from known where estado = 'O' and origin = '2-HIGH' and fecha between date '1996-01-01' and date '1996-06-30'")
def f5(c):
    return scope.resolve(c.documents, c.values, [("Estado", "O")], "2-HIGH", ("Fecha", FIRST, LAST))


@query("F6_satisfies", "select count(*) > 0 as satisfies from known where id = 7 and estado = 'F'")
def f6(c):
    return scope.satisfies(c.documents, c.values, 7, [("Estado", "F")])


@query("F7_currency", "select id as document_id, importe::double as numeric from known where currency = 'MXN'")
def f7(c):
    return doubles(scope.in_currency(c.values.where("concept = 'Importe total'"), "mxn").select("document_id", "numeric"), "numeric")


@query("F8_identifier_exact", "select id as document_id, 140 as score from known where id = 42")
def f8(c):
    return scope.by_identifier(c.values, "oc 0000042")


@query("F8_identifier_prefix", "select id as document_id, 130 as score from known where 'oc' || lpad(id::varchar, 7, '0') like 'oc00012%' and 'oc' || lpad(id::varchar, 7, '0') <> 'oc00012'")
def f8p(c):
    return scope.by_identifier(c.values, "OC/00012", "prefix")


@query("F9_literal", "select distinct doc_id as document_id, 115 as score from documents where lower(text) like '%version 2.0%' and not contains(text, chr(7))")
def f9(c):
    return search.literal_hits(c.chunks, "Version 2.0")


@query("F10_complete_value", r"select doc_id as document_id from documents where regexp_matches(lower(text), '(^|[^\pL\pN_/.\-])the and([^\pL\pN_/.\-]|$)')")
def f10(c):
    return c.chunks.where(text.holds_value("content", "the and")).select("document_id").distinct()


@query("F11_phrase", r"select distinct doc_id as document_id from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where contains(' ' || trim(regexp_replace(lower(strip_accents(line)), '[^\pL\pN]+', ' ', 'g')) || ' ', ' of the ')")
def f11(c):
    return search.phrase_hits(c.chunks, "of the")


@query("F12_terms", r"select count(*) as n from documents where length(array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\pL\pN]+'), lambda w: starts_with(w, 'thea')), ' ')) > 0")
def f12(c):
    whole = c.chunks.where(text.holds_terms("content", ["thea"])).select("document_id").distinct()
    return whole.agg(F.count("*").alias("n"))


@query("F20_mentioned_values", "select distinct 'Segmento' as concept, lower(segmento) as literal_value from known where segmento in ('BUILDING', 'MACHINERY') union select 'Cliente', 'cl-7' from known where o_custkey = 7 union select 'Estado', 'f' from known where estado = 'F'")
def f20(c):
    return scope.mentioned_values(c.values, "¿Cuánto suman building y machinery de CL-7 con F?")


@query("F21_by_path", "select id as document_id from known where lpad(id::varchar, 7, '0') = '0000099'")
def f21(c):
    return scope.by_path(c.documents, "0000099_pedido.csv").select("document_id")


@query("F16_near_values", "select text_value, distance from (select distinct segmento as text_value, levenshtein(lower(segmento), 'bulding')::int as distance from known) order by distance, lower(text_value) limit 6")
def f16(c):
    return scope.near_values(c.values, "Segmento", "bulding").select("text_value", "distance")


@query("F22_pinned", "select id as document_id, 2004::bigint as score from known where id = 42")
def f22(c):
    """Two anchors of one document; a repeated one counts once."""
    return scope.pinned(c.values, ["OC-0000042", "000004", "OC-0000042"])


@query("F23_projection", "select concept, text_value from (select 'Estado' as concept, estado as text_value from known where id = 42 union all select 'Folio', 'OC-0000042' union all select 'Cliente', 'CL-' || o_custkey from known where id = 42)")
def f23(c):
    return scope.projection(c.values, 42, ["Folio", "Estado", "Cliente"])


@table_query("F24_excerpt", "select doc_id as document_id, substr(text, greatest(1, strpos(lower(strip_accents(text)), 'license') - 176)::bigint, 360) as excerpt from documents")
def f24_whole(spark, d):
    """Excerpts of the whole texts of all documents, around a term that lies deep in some."""
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), text.excerpt("text", "license").alias("excerpt"))


@query("F25_substantive", "select 6 * (select count(*) from known) + 5 * (select count(*) from items) - (select count(*) from known) as n")
def f25(c):
    """All fields; segments and totals are said to stand in a file's metadata, and the totals, being numbers, stay."""
    said = F.when(F.col("concept").isin("Segmento", "Importe total"), F.lit("metadato:x")).otherwise(F.col("location"))
    return scope.substantive(c.values.withColumn("location", said)).agg(F.count("*").alias("n"))


@query("P28_authorised", "select count(*) as n from known where id % 3 <> 0")
def p28(c):
    sources = c.documents.select((F.col("document_id") % 3).alias("source_id")).distinct().withColumn("revoked_at", F.when(F.col("source_id") == 0, F.lit("2024-01-01")))
    return scope.authorised(c.documents.withColumn("source_id", F.col("document_id") % 3), sources).agg(F.count("*").alias("n"))


# ---- joins ----------------------------------------------------------------------------------------


@query("J1_facts_dimensions", "select origin, 'Importe total' as concept, count(*) as n, sum(importe)::double as total from known group by origin")
def j1(c):
    return doubles(c.values.where("concept = 'Importe total'").join(c.documents, "document_id").groupBy("origin", "concept").agg(F.count("*").alias("n"), F.sum("numeric").alias("total")), "total")


@table_query("J3_left_count", "select c_mktsegment as segment, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
def j3_tables(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return rel.with_counts(customers, orders, "k", "segment", "o_orderkey")


@query("J4_semi", "select id as document_id from known where exists (select 1 from items i where i.id = known.id and retorno = 'R')")
def j4(c):
    return scope.having(c.documents, c.values, scope.equals("Retorno", "r")).select("document_id")


@query("J5_anti", "select id as document_id from known where not exists (select 1 from items i where i.id = known.id and retorno = 'R')")
def j5(c):
    return scope.without(c.documents, c.values, scope.equals("Retorno", "R")).select("document_id")


@query("J6_row_labels", "select r as grp, sum(cantidad)::double as value, count(*) as n_values from items join (select distinct id, fila, retorno as r from items) using (id, fila) group by 1")
def j6(c):
    rows = agg.labelled(c.values.where("concept = 'Cantidad'"), c.values.where("concept = 'Retorno'"))
    return doubles(agg.compute(rows, "sum", ["grp"]).select("grp", "value", "n_values"), "value")


@query("J6_missing_labels", "select coalesce(r, 'Sin valor') as grp, sum(cantidad)::double as value from items left join (select distinct id, fila, retorno as r from items where retorno = 'R') using (id, fila) group by 1")
def j6m(c):
    rows = agg.labelled(c.values.where("concept = 'Cantidad'"), c.values.where("concept = 'Retorno' and text_value = 'R'"))
    return doubles(agg.compute(rows, "sum", ["grp"]).select("grp", "value"), "value")


@query("J6_both_labels", """, etiquetas as (select id, fila, retorno as r from items where retorno = 'R' union all select id, null, estado from known)
select part, coalesce(r, 'Sin valor') as grp, sum(x)::double as value, count(*) as n_values from (
  select 'Cantidad' as part, cantidad as x, r from items left join (select distinct id, fila, r from etiquetas where fila is not null) using (id, fila)
  union all select 'Importe total', importe, r from known left join (select distinct id, r from etiquetas) using (id)) group by 1, 2""")
def j6_both(c):
    """The label field stands in some records and in the documents too: records take only their own, documents all of theirs."""
    labels = c.values.where("concept = 'Retorno' and text_value = 'R' or concept = 'Estado'")
    rows = agg.labelled(c.values.where("concept in ('Cantidad', 'Importe total')"), labels)
    out = rows.groupBy(F.col("concept").alias("part"), "grp").agg(F.sum("numeric").alias("value"), F.count("*").alias("n_values"))
    return doubles(out, "value")


@query("J8_shared_key", "select 'cl' || o_custkey as key, count(*) as n_documents from known group by 1 having count(*) > 1")
def j8(c):
    return rel.sharing(c.values, "Cliente").groupBy("key").agg(F.count("*").alias("n_documents"))


@table_query("J9_same_content", "select doc_id as document_id, n from (select doc_id, count(*) over (partition by text) as n from documents) where n > 1")
def j9(spark, d):
    return rel.copies_of_each(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash")))


@query("J10_exists_flag", "select id as document_id, exists (select 1 from items i where i.id = known.id and retorno = 'A') as is_entity from known")
def j10(c):
    return scope.flagged(c.documents, c.values, scope.equals("Retorno", "A"), "is_entity").select("document_id", "is_entity")


# ---- aggregation ----------------------------------------------------------------------------------


for _op, _sql in (("sum", "sum(importe)::double"), ("min", "min(importe)::double"), ("max", "max(importe)::double"), ("average", MEAN.format(x="importe"))):

    @query(f"A1_{_op}", f"select estado as grp, currency, {_sql} as value, count(*) as n_values, count(distinct id) as n_documents, true as reliable from known group by 1, 2")
    def a1(c, op=_op):
        rows = agg.labelled(c.values.where("concept = 'Importe total'"), c.values.where("concept = 'Estado'"))
        return doubles(agg.compute(rows, op, ["grp"]), "value")


@query("A1_count", "select estado as grp, count(*)::double as value, count(*) as n_values, count(distinct id) as n_documents, true as reliable from known group by 1")
def a1c(c):
    rows = agg.labelled(c.values.where("concept = 'Importe total'"), c.values.where("concept = 'Estado'"))
    return doubles(agg.compute(rows, "count", ["grp"]), "value")


@query("A2_exact_mean", f"select currency, {MEAN.format(x='precio')} as mean from items group by 1")
def a2(c):
    return doubles(c.values.where("concept = 'Precio'").groupBy("currency").agg(val.exact_mean(F.sum("numeric"), F.count("numeric")).alias("mean")), "mean")


@query("A3_accounted_sum", "select currency, sum(importe)::double as value, n_scope, n_calculated, 0::bigint as n_missing, n_scope - n_calculated as n_currency, 0::bigint as n_invalid, n_scope = n_calculated as verified from known, (select count(*) as n_scope, count_if(currency = 'USD')::bigint as n_calculated from known where estado = 'F') where estado = 'F' and currency = 'USD' group by all")
def a3(c):
    return doubles(agg.aggregate(c.values, scope.with_filters(c.documents, c.values, [("Estado", "F")]), "Importe total", "sum", "USD"), "value")


@query("A4_inherited_scope", "select currency, sum(importe)::double as value from known where estado = 'F' and segmento = 'BUILDING' group by 1")
def a4(c):
    first = scope.with_filters(c.documents, c.values, [("Estado", "F")])
    return doubles(agg.compute(agg.operands(c.values, "Importe total", scope.with_filters(first, c.values, [("Segmento", "BUILDING")])), "sum").select("currency", "value"), "value")


@query("A5_several_fields", "select * from (select 'Cantidad' as concept, null as currency, sum(cantidad)::double as value from items group by 2 union all select 'Precio', currency, sum(precio)::double from items group by 2)")
def a5(c):
    return doubles(agg.compute(c.values.where("concept in ('Cantidad', 'Precio')"), "sum", ["concept"]).select("concept", "currency", "value"), "value")


_CATEGORIES = """, m as (select 'money' as kind, id, importe as x, currency from known union all select 'money', id, precio, currency from items union all select 'number', id, cantidad, null from items union all select 'percentage', id, descuento, null from items),
g as (select kind, id, count(*) as n, max(x) as x, max(currency) as currency from m group by 1, 2)"""


def _by_category(c: Corpus) -> DataFrame:
    each = [agg.compute_category(c.values, c.documents, k).withColumn("kind", F.lit(k)) for k in agg.NUMERIC]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("A6_category", f"{_CATEGORIES} select kind, currency, sum(x)::double as value from g where n = 1 group by 1, 2")
def a6(c):
    """Any field of a kind: most orders state several amounts and count for nothing."""
    return doubles(_by_category(c).where("value is not null").select("kind", "currency", "value"), "value")


@query("A6_category_account", f"{_CATEGORIES} select kind, (select count(*) from known) as n_scope, (select count(*) from known) - count(*) as n_none, count_if(n > 1)::bigint as n_several, count_if(n = 1)::bigint as n_calculated from g group by 1")
def a6a(c):
    return _by_category(c).select("kind", "n_scope", "n_none", "n_several", "n_calculated").distinct()


for _op in ("subtract", "multiply", "divide"):
    _value = {
        "subtract": "importe - precio",
        "multiply": "null",
        "divide": "((sign(importe) * sign(precio)) * ((2 * abs((importe * 10000)::hugeint) * 10000 + abs((precio * 10000)::hugeint)) // (2 * abs((precio * 10000)::hugeint))))::double / 10000",
    }[_op]
    if _op == "multiply":
        _sql = "select currency as unit, null::varchar as issue, sum(round(precio::decimal(18,4) * cantidad1::decimal(18,4), 4))::double as total, count(*) as n_rows from (select i.*, first_value(cantidad) over (partition by id order by linea, fila) as cantidad1 from items i) group by 1"
    else:
        _sql = f"select {'currency' if _op == 'subtract' else 'null::varchar'} as unit, null::varchar as issue, sum({_value})::double as total, count(*) as n_rows from known join (select id, first(precio order by linea, fila) as precio from items group by 1) using (id) group by 1"

    @query(f"A7_{_op}", _sql)
    def a7(c, op=_op):
        pair = ("Precio", "Cantidad") if op == "multiply" else ("Importe total", "Precio")
        out = agg.row_totals(agg.row_operation(c.values, *pair, op)).select("unit", "issue", "total", "n_rows")
        return doubles(out.withColumn("total", F.round(F.col("total"), 4)), "total")


@query("A8_one_document", "select id as document_id, (importe - precio)::double as result from known join (select id, first(precio order by linea, fila) as precio from items group by 1) using (id) where id = 3")
def a8(c):
    return doubles(agg.row_operation(c.values.where("document_id = 3"), "Importe total", "Precio", "subtract").select("document_id", "result"), "result")


@query("A9_count_documents", "select count(*) as n from known where estado = 'P'")
def a9(c):
    return scope.with_filters(c.documents, c.values, [("Estado", "P")]).agg(F.count("*").alias("n"))


def _and_texts(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and unread files of the corpus, with the longer texts as documents of their own; one in three was read by OCR."""
    c, texts = orders_corpus(spark, d), spark.read.parquet(f"{d}/documents.parquet").where("n_chars >= 200")
    path = F.concat("source", F.lit("/"), F.col("doc_id"), F.lit("_texto.txt"))
    status = F.when(F.col("n_chars") % 3 == 0, "complete").otherwise("not_required")
    read = texts.select((-1 - F.col("doc_id")).alias("document_id"), path.alias("path"), F.col("source").alias("origin"), F.lit("txt").alias("extension"), status.alias("ocr_status"))
    return c.documents.select(*read.columns).unionByName(read), c.unindexed


@table_query("A10_formats", "select 'csv' as extension, count(*) as n_documents, 0::bigint as n_scanned, count(*) as n_text, 0::bigint as n_unindexed from orders union all select 'txt', count_if(n_chars >= 200)::bigint, count_if(n_chars >= 200 and n_chars % 3 = 0)::bigint, count_if(n_chars >= 200 and n_chars % 3 <> 0)::bigint, count_if(n_chars < 200)::bigint from documents")
def a10(spark, d):
    return rel.by_format(*_and_texts(spark, d))


@table_query("A11_census", "select kind, count(*) as discovered, sum(i)::bigint as indexed, count_if(i = 0)::bigint as unindexed from (select 'pedido' as kind, 1 as i from orders union all select case when source is null then 'sin tipo' else 'texto' end, (n_chars >= 200)::int from documents where n_chars is not null) group by 1")
def a11(spark, d):
    return rel.census(*_and_texts(spark, d), ["kind"])


@query("A12_inventory", "select origin, count(*) as n_documents, min(id) as first from known group by 1")
def a12(c):
    return rel.inventory(c.documents)


_FIELDS = [("Folio", "text", "known"), ("Estado", "state", "known"), ("Fecha", "date", "known"), ("Importe total", "money", "known"), ("Cliente", "text", "known"), ("Segmento", "text", "known"), ("Cantidad", "number", "items"), ("Precio", "money", "items"), ("Descuento", "percentage", "items"), ("Retorno", "state", "items"), ("Envio", "date", "items")]
_ALL_FIELDS = " union all ".join(f"select '{name}' as concept, count(*)::bigint as n_values, '{kind}' as kind from {table}" for name, kind, table in _FIELDS)


@query("A13_catalogue", _ALL_FIELDS)
def a13(c):
    return agg.catalogue(c.values)


@query("A14_distinct", "select distinct segmento as text_value from known order by 1 limit 200")
def a14(c):
    return agg.distinct_values(c.values, "Segmento")


@query("A15_currencies", "select distinct currency from known")
def a15(c):
    return c.values.where("currency is not null").select("currency").distinct()


@query("A15_extensions", "select 'csv' as extension union select 'txt' from documents where n_chars < 200")
def a15e(c):
    return c.documents.select("extension").union(c.unindexed.select("extension")).distinct()


@table_query("A16_signs", "select 'c_acctbal' as concept, count(*) as n_numeric, count_if(c_acctbal < 0)::bigint as n_negative, count(*) >= 20 and count_if(c_acctbal < 0) * 20 <= count(*) as negative_is_odd from customer union all select 's_acctbal', count(*), count_if(s_acctbal < 0)::bigint, count(*) >= 20 and count_if(s_acctbal < 0) * 20 <= count(*) from supplier")
def a16(spark, d):
    one = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(c).alias("concept"), F.col(c).cast(val.AMOUNT).alias("numeric"))
    return agg.signs(one("customer", "c_acctbal").unionByName(one("supplier", "s_acctbal")))


@query("A18_type_vote", f"select part as concept, sum(n)::bigint as n_values, first(kind order by n desc, list_position(['money', 'date', 'percentage', 'number', 'state', 'text'], kind)) as kind from (select case when concept in ('Folio', 'Estado', 'Fecha', 'Importe total', 'Cliente', 'Segmento') then 'documento' else 'registro' end as part, kind, sum(n_values) as n from ({_ALL_FIELDS}) group by 1, 2) group by 1")
def a18(c):
    """All values of documents vote on one kind, and all values of records; ties go by the order of kinds."""
    return agg.catalogue(c.values.withColumn("concept", F.when(F.col("record_scope").isNull(), "documento").otherwise("registro")))


@table_query("A19_duplicates", "select n, count(*) as groups from (select count(*) as n from documents group by text having count(*) > 1) group by 1")
def a19(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash"))
    return rel.duplicates(docs).groupBy(F.col("n_documents").alias("n")).agg(F.count("*").alias("groups"))


@query("A20_folder_values", "select lower(estado) as literal_value, origin, n_value, n_folder, n_origins = 1 and n_value = n_folder as equivalent from (select estado, count(distinct id) as n_value, count(distinct origin) as n_origins, min(origin) as origin from known group by 1) join (select origin, count(*) as n_folder from known group by 1) using (origin)")
def a20(c):
    return rel.names_folder(c.documents, c.values, "Estado")


@query("A21_summary", "select value_type, currency, min(x)::double as low, max(x)::double as high, case when value_type <> 'percentage' then sum(x)::double end as total, count(*) as n from (select 'money' as value_type, currency, importe as x from known union all select 'money', currency, precio from items union all select 'number', null, cantidad from items union all select 'percentage', null, descuento from items) group by 1, 2")
def a21(c):
    return doubles(agg.summary(c.values), "low", "high", "total")


@query("A22_value_list", "select lower(segmento) as literal_value, count(*) as n, greatest((select count(distinct segmento) from known) - 3, 0) as n_more from known group by 1 order by 1 limit 3")
def a22(c):
    return agg.value_list(c.values.where("concept = 'Segmento'"), 3)


@table_query("A23_status", "select (select count(*) from orders) as n_orders, (select count(*) from lineitem) as n_items, (select count(*) from documents) as n_texts, (select count(*) from nation) as n_nations")
def a23(spark, d):
    return rel.status({k: spark.read.parquet(f"{d}/{t}.parquet") for k, t in (("n_orders", "orders"), ("n_items", "lineitem"), ("n_texts", "documents"), ("n_nations", "nation"))})


_COLUMNS = {"Folio": "id", "Estado": "estado", "Fecha": "fecha", "Importe total": "importe", "Cliente": "o_custkey", "Segmento": "segmento", "Cantidad": "cantidad", "Precio": "precio", "Descuento": "descuento", "Retorno": "retorno", "Envio": "envio"}
_ACROSS = " union all ".join(f"select '{name}' as concept, count(distinct id) as n_documents, count(distinct {_COLUMNS[name]}) as n_distinct from {table} where id in (select id from read)" for name, _, table in _FIELDS)


@query("A24_fields_across", f", read as (select id from known where estado = 'F' and segmento = 'BUILDING'), f as ({_ACROSS}) select concept, n_documents, n_distinct, n_read, n_distinct = 1 and n_documents = n_read as common from f, (select count(*) as n_read from read) where n_documents > 0")
def a24(c):
    """All fields of a reading of many documents, which agree in state and segment."""
    read = scope.resolve(c.documents, c.values, [("Estado", "F"), ("Segmento", "BUILDING")])
    return agg.fields_across(c.values.join(read.select("document_id"), "document_id", "left_semi"))


@query("V4_agreed_value", "select count(*) as n_documents, count(distinct estado) as n_values, min(id) as principal, case when count(distinct estado) = 1 then min(estado) end as value, case count(distinct estado) when 0 then 'absent' when 1 then 'agreed' else 'differing' end as outcome, true as reliable from known where segmento = 'BUILDING' and origin = '1-URGENT'")
def v4(c):
    return agg.agreed_value(c.values, scope.resolve(c.documents, c.values, [("Segmento", "BUILDING")], "1-URGENT"), "Estado")


@query("V4_one_document", "select 1::bigint as n_documents, 1::bigint as n_values, id as principal, segmento as value, 'agreed' as outcome, true as reliable from known where id = 42")
def v4_one(c):
    return agg.agreed_value(c.values, scope.by_identifier(c.values, "OC-0000042"), "Segmento")


@query("V5_labelled_rows", "select id as document_id, fila as record_scope, cantidad::double as numeric from items where retorno = 'R'")
def v5(c):
    return doubles(agg.in_labelled_rows(c.values, "R", "Cantidad").select("document_id", "record_scope", "numeric"), "numeric")


@query("V6_related", "select id as document_id from known where o_custkey = (select o_custkey from known where id = 42) and id <> 42 order by id limit 12")
def v6(c):
    return rel.related(c.values, "Cliente", 42)


@query("V11_unreliable", "select id as document_id, 'lectura_dudosa' as reason from known where origin = '5-LOW'")
def v11(c):
    return rel.unreliable(c.documents.withColumn("ocr_status", F.when(F.col("origin") == "5-LOW", "low_confidence").otherwise(F.col("ocr_status"))))


@query("P12_operand", "select id as document_id, case when count(distinct cantidad) = 1 then min(cantidad) end::double as numeric, case when count(distinct cantidad) > 1 then 'operando_multiple_en_documento' end as issue from items group by 1")
def p12(c):
    return doubles(agg.operand(c.values, "Cantidad"), "numeric")


@query("P25_citations", "select origin, document_id, turn::int as turn from (select origin, id as document_id, row_number() over (partition by origin order by id) as turn from known) order by turn, origin limit 18")
def p25(c):
    return agg.sampled_citations(c.documents, "origin")


@query("F18_usual_fields", "select 'Retorno' as concept, count(distinct id) as n_documents from items where retorno = 'R' union all select 'Estado', count(*) from known where estado = 'R' having count(*) > 0")
def f18(c):
    return scope.usual_fields(c.values, "R")


# ---- comparison -----------------------------------------------------------------------------------


@query("C1_ranking", "select segmento as grp, currency, sum(importe)::double as value from known group by 1, 2")
def c1(c):
    rows = agg.labelled(c.values.where("concept = 'Importe total'"), c.values.where("concept = 'Segmento'"))
    return doubles(rel.rank(rows, "grp").select("grp", "currency", "value"), "value")


_CHANGE = "l::double as left_value, r::double as right_value, (r - l)::double as difference, (case when l <> 0 then sign(r - l) * sign(l) * ((2 * abs(((r - l) * 10000)::hugeint) * 1000000 + abs((l * 10000)::hugeint)) // (2 * abs((l * 10000)::hugeint))) end)::double / 10000 as percent"


@query("C2_groups", f"select currency, {_CHANGE} from (select currency, sum(importe) filter (segmento = 'BUILDING') as l, sum(importe) filter (segmento = 'MACHINERY') as r from known group by 1)")
def c2(c):
    side = lambda v: agg.operands(c.values, "Importe total", scope.with_filters(c.documents, c.values, [("Segmento", v)]))
    return doubles(rel.compare(side("BUILDING"), side("MACHINERY")), "left_value", "right_value", "difference", "percent")


@query("C3_periods", f"select currency, {_CHANGE} from (select currency, sum(importe) filter (year(fecha) = 1995) as l, sum(importe) filter (year(fecha) = 1996) as r from known where year(fecha) in (1995, 1996) group by 1)")
def c3(c):
    return doubles(rel.compare_periods(c.values, "Importe total", "Fecha", periods.year(1996)), "left_value", "right_value", "difference", "percent")


@query("C5_two_documents", "select lower((select estado from known where id = 1)) as first, lower((select estado from known where id = 2)) as second, case when (select estado from known where id = 1) <> (select estado from known where id = 2) then 'valores_discrepantes' else 'coinciden' end as outcome")
def c5(c):
    return rel.compare_documents(c.values, "Estado", 1, 2)


@query("C6_contradictions", "select 'cl' || o_custkey as key, count(distinct estado) as n_values, count(*) as n_documents, lower(min(estado)) as low, lower(max(estado)) as high from known where o_custkey in (select o_custkey from known group by 1 having count(*) > 1) group by 1 having count(distinct estado) > 1")
def c6(c):
    return rel.contradictions(c.values, "Cliente", "Estado").drop("reliable")


@query("C7_dossier", "select concept, n_documents, n_values, n_linked - n_documents as n_gaps, n_values > 1 as conflict from (select 'Estado' as concept, count(*) as n_documents, count(distinct estado) as n_values, count(*) as n_linked from known where o_custkey = (select min(o_custkey) from known) union all select 'Nada', 0, 0, count(*) from known where o_custkey = (select min(o_custkey) from known))")
def c7(c):
    least = c.values.where("concept = 'Cliente'").agg(F.min(F.substring("text_value", 4, 30).cast("long")).alias("k")).first().k
    return rel.dossier(c.values, "Cliente", f"cl{least}", ["Estado", "Nada"])


@query("C8_mentions", "select id as document_id from known where estado = 'F' order by id limit 20")
def c8(c):
    """A segment is no identifier, so that no document has it as a key."""
    return rel.mentions(c.values, "Segmento", scope.equals("Estado", "F"))


@query("C9_identifiers", "select key from (select distinct 'oc' || lpad(id::varchar, 7, '0') as key from known) where key like 'oc00001%' order by 1 limit 6")
def c9(c):
    return rel.identifier_candidates(c.values, "Folio", "OC-00001")


@table_query("C10_identical_to", "select doc_id as document_id from documents where text = (select text from documents where doc_id = 0) and doc_id <> 0")
def c10(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash"))
    return rel.duplicates_of(docs, 0)


@table_query("C4_change", "select s_nationkey, l::double as left_value, r::double as right_value, (r - l)::double as difference, (case when l <> 0 then sign(r - l) * sign(l) * ((2 * abs(((r - l) * 10000)::hugeint) * 1000000 + abs((l * 10000)::hugeint)) // (2 * abs((l * 10000)::hugeint))) end)::double / 10000 as percent from (select s_nationkey, min(s_acctbal::decimal(24,4)) as l, max(s_acctbal::decimal(24,4)) as r from supplier group by 1)")
def c4(spark, d):
    n = F.col("s_acctbal").cast(val.AMOUNT)
    sides = spark.read.parquet(f"{d}/supplier.parquet").groupBy("s_nationkey").agg(F.min(n).alias("left_value"), F.max(n).alias("right_value"))
    return doubles(rel.changes(sides), "left_value", "right_value", "difference", "percent")


@query("P24_other_currencies", "select id as document_id from known where currency <> 'MXN'")
def p24(c):
    return scope.by_currency(c.values.where("concept = 'Importe total'"), "MXN")[1]


@table_query("P26_first_chunk", "select doc_id as document_id, string_split(text, chr(10))[1] as content from documents")
def p26(spark, d):
    return search.first_chunks(orders_corpus(spark, d).chunks)


@query("P26_members", "select id as document_id, hit from (select id, 'field' as hit from known where segmento = 'BUILDING' and id in (select id from items) union all select id, 'hash' from known where (o_custkey, estado, importe) in (select (o_custkey, estado, importe) from known where segmento = 'BUILDING' and estado = 'P'))")
def p26_members(c):
    """Members of a scope that state a price, and documents with the content of other members."""
    members = scope.with_filters(c.documents, c.values, [("Segmento", "BUILDING")])
    same = scope.by_hash(c.documents, scope.with_filters(members, c.values, [("Estado", "P")]))
    stating = scope.members_stating(members, c.values, "Precio").select("document_id", F.lit("field").alias("hit"))
    return stating.unionByName(same.select("document_id", F.lit("hash").alias("hit")))


@table_query("A17_odd_negatives", "select 'saldo ' || c_nationkey as concept from customer group by 1 having count(*) >= 20 and count_if(c_acctbal < 0) * 20 <= count(*) union all select 's_acctbal' from supplier having count(*) >= 20 and count_if(s_acctbal < 0) * 20 <= count(*) union all select 'p_retailprice' from part having count(*) >= 20 and count_if(p_retailprice < 0) * 20 <= count(*)")
def a17(spark, d):
    """Balances of customers by nation, of suppliers, and prices."""
    rows = lambda t, concept, x: spark.read.parquet(f"{d}/{t}.parquet").select(concept.alias("concept"), F.col(x).cast(val.AMOUNT).alias("numeric"))
    every = rows("customer", F.concat(F.lit("saldo "), "c_nationkey"), "c_acctbal").unionByName(rows("supplier", F.lit("s_acctbal"), "s_acctbal")).unionByName(rows("part", F.lit("p_retailprice"), "p_retailprice"))
    return agg.signs(every).where("negative_is_odd").select("concept")


@table_query("X8_civil_dates", "select o_orderkey, last_day(o_orderdate::date) as month_end, date_diff('day', date '1992-01-01', o_orderdate::date)::int as days from orders")
def x8(spark, d):
    day = F.col("o_orderdate").cast("date")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.last_day(day).alias("month_end"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days"))


@table_query("S19_entities", r"select conv_id as document_id, text as name from (select conv_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^\p{Lu}\p{L}+')) as capitals, regexp_split_to_array(text, '\s+') as w from conversations where text is not null) where len(w) <= 14 and (len(capitals) >= 2 or regexp_matches(text, 'S\.A\.|S\.C\.'))")
def s19(spark, d):
    from .sources.index import entities

    talk = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("document_id"), F.col("role").alias("concept"), F.col("text").alias("text_value"), F.lit("text").alias("value_type"))
    return entities(talk).select("document_id", "name")


@table_query("S16_chunks")
def s16(spark, d):
    from .sources.files import chunk_rows

    return chunk_rows(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text"))


# ---- search ---------------------------------------------------------------------------------------

_LINES = r"""lines as (select document_id, ordinal::int as ordinal, content, list_filter(regexp_split_to_array(lower(strip_accents(content)), '[^\pL\pN]+'), lambda w: w <> '') as w from (select doc_id as document_id, generate_subscripts(l, 1) - 1 as ordinal, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents)))"""


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count_if(tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(w) / mean))" for i in range(len(terms)))
    return f"with {_LINES}, c as (select *, {tf} from lines), t as (select count(*) as n, avg(len(w)) as mean, {df} from c), s as (select c.*, {score} as bm from c, t)"


@table_query("T6_all_terms", _bm25_sql(["with", "thea"]) + " select document_id, round(max(20 + bm), 6) as score from s where tf0 > 0 and tf1 > 0 group by 1 order by 2 desc, 1 limit 12")
def t6(spark, d):
    return search.all_terms(orders_corpus(spark, d).chunks, "with thea").select("document_id", F.round("score", 6).alias("score"))


@table_query("T7_free_text", _bm25_sql(["with", "thea", "license"]) + """, m as (select *, (tf0 > 0)::int + (tf1 > 0)::int + (tf2 > 0)::int as k, (tf0 > 0)::int * 4 + (tf1 > 0)::int * 4 + (tf2 > 0)::int * 7 as spec from s),
d as (select document_id, max((tf0 > 0)::int) + max((tf1 > 0)::int) + max((tf2 > 0)::int) as dk from s group by 1),
x as (select document_id, ordinal, content, 50.0 * k / 3 + 3 * spec + least(length(content), 1000) / 100 + bm + 100.0 * dk / 3 as score from m join d using (document_id) where k >= 2),
b as (select * from x qualify row_number() over (partition by document_id order by score desc, ordinal) = 1),
o as (select * from b qualify row_number() over (partition by content order by score desc, document_id) = 1)
select document_id, round(score, 6) as score from o order by score desc, document_id limit 20""")
def t7(spark, d):
    return search.free_text(orders_corpus(spark, d).chunks, "with thea license").select("document_id", F.round("score", 6).alias("score"))


@table_query("T8_best_per_document", f"with {_LINES} select document_id, len(w) as n, ordinal from lines qualify row_number() over (partition by document_id order by len(w) desc, ordinal) = 1")
def t8(spark, d):
    hits = orders_corpus(spark, d).chunks.withColumn("n", F.size(text.words("content")).cast("long"))
    return search.best_per_document(hits, [F.desc("n"), F.asc("ordinal")]).select("document_id", "n", "ordinal")


@table_query("T9_best_line", f"with {_LINES}, s as (select document_id, ordinal as line, content as text, ((len(list_filter(w, lambda x: starts_with(x, 'with'))) > 0)::int + (len(list_filter(w, lambda x: starts_with(x, 'thea'))) > 0)::int)::int as n_terms from lines) select document_id, 0 as ordinal, line, sha256(text) as text, n_terms from s qualify row_number() over (partition by document_id order by n_terms desc, line desc) = 1")
def t9(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.col("text").alias("content"))
    return search.best_line(docs, ["with", "thea"]).withColumn("text", F.sha2("text", 256))


@query("T4_metadata", "select id as document_id, 90 as score from known where origin = '1-URGENT'")
def t4(c):
    return search.metadata_hits(c.documents, "urgent", True)


@query("T5_structured", "select id as document_id, 120 as score from known where segmento = 'BUILDING'")
def t5(c):
    return search.structured_hits(c.documents, c.values, "building")


@query("T2_strict_exact", r"select id as document_id, 120 as score from known where segmento = 'MACHINERY' union all select doc_id, 115 from documents where regexp_matches(lower(text), '(^|[^\pL\pN_/.\-])machinery([^\pL\pN_/.\-]|$)') and doc_id not in (select id from known where segmento = 'MACHINERY')")
def t2(c):
    return search.strict_exact(c.documents, c.values, c.chunks, "Machinery")


@query("T3_strict_structured", "select id as document_id, 120 as score from known where segmento = 'BUILDING' and estado = 'F' and exists (select 1 from items i where i.id = known.id and retorno = 'R')")
def t3(c):
    return search.strict_structured(c.documents, c.values, [("Segmento", "building"), ("Estado", "f"), ("Retorno", "R")])


# ---- functions ------------------------------------------------------------------------------------


@table_query("S6_label_lines", r"select role as label, count(*) as n from conversations where regexp_matches(text, '\S') group by 1")
def s6(spark, d):
    from .sources.files import label_lines

    talk = spark.read.parquet(f"{d}/conversations.parquet")
    lines = talk.select(F.col("conv_id").alias("document_id"), F.concat("role", F.lit(": "), F.regexp_replace("text", "\n", " ")).alias("content"))
    return label_lines(lines).groupBy("label").agg(F.count("*").alias("n"))


@table_query("X1_fold", "select doc_id, lower(strip_accents(text)) as folded from documents")
def x1_whole(spark, d):
    """Whole texts of all rows."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.folded("text").alias("folded"))


@table_query("X3_identifier", "select p_partkey, 'mfr' || p_partkey as identifier from part")
def x3(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.identifier_of(F.concat(F.lit("MFR-"), "p_partkey")).alias("identifier"))


@table_query("X4_typed_values", "select case c_custkey % 4 when 0 then 'money' when 1 then 'date' when 2 then 'percentage' else 'number' end as kind, count(*) as n from customer group by 1")
def x4(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("$"), k, F.lit(".50 MXN"))).when(k % 4 == 1, F.lit("3 de marzo de 2024")).when(k % 4 == 2, F.concat(k, F.lit("%"))).otherwise(k.cast("string"))
    typed = spark.read.parquet(f"{d}/customer.parquet").select(val.kind_of(F.lit("Campo"), raw).alias("kind"))
    return typed.groupBy("kind").agg(F.count("*").alias("n"))


@table_query("X11_sha256", "select doc_id, sha256(text) as content_hash from documents")
def x11(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@table_query("X12_kind_of_path", "select lower(lang) || '_nota' || (doc_id % 7)::varchar || '_' || lower(source) as kind, count(*) as n from documents group by 1")
def x12(spark, d):
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("_"), "lang", F.lit(" Nota"), (F.col("doc_id") % 7).cast("string"), F.lit(" - "), "source", F.lit(".md"))
    return spark.read.parquet(f"{d}/documents.parquet").select(text.kind_of_path(path).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


from . import queries_index  # noqa: E402, F401  (registers its own)
