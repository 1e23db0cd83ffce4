"""The evidence model over relational tables.

A row is a document or a record of one, a column is a field. Every field is a
branch of a union with its name as a literal, so that a filter on the name
leaves only the branches it needs: only their columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded, identifier_of
from ..functions.values import AMOUNT

#: Currency by region: the tables have none. A fixed rule of the test mapping.
CURRENCIES = ["MXN", "USD", "EUR", "GBP", "JPY"]


@dataclass
class Corpus:
    """documents (document_id, path, title, origin, extension, content_hash, ocr_status, ocr_confidence),
    values (document_id, concept, ordinal, value_type, text_value, numeric, currency, date_value, record_scope, location, reliable),
    unindexed (path, origin, extension, reason), chunks (document_id, ordinal, content)."""

    documents: DataFrame
    values: DataFrame
    unindexed: DataFrame
    chunks: DataFrame


def field(rows: DataFrame, document: str, name: str, kind: str, text: Column, ordinal: int, numeric: Column | None = None, currency: Column | None = None, day: Column | None = None, scope: Column | None = None) -> DataFrame:
    none = F.lit(None)
    where = F.coalesce(scope, F.lit(f"campo {name}")) if scope is not None else F.lit(f"campo {name}")
    return rows.where(text.isNotNull()).select(
        F.col(document).cast("long").alias("document_id"),
        F.lit(name).alias("concept"),
        F.lit(ordinal).alias("ordinal"),
        F.lit(kind).alias("value_type"),
        text.cast("string").alias("text_value"),
        folded(text.cast("string")).alias("literal_value"),
        (numeric if numeric is not None else none).cast(AMOUNT).alias("numeric"),
        (currency if currency is not None else none).cast("string").alias("currency"),
        (day if day is not None else none).cast("date").alias("date_value"),
        (scope if scope is not None else none).cast("string").alias("record_scope"),
        where.alias("location"),
        F.lit(True).alias("reliable"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def currency_of(region: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CURRENCIES)), region + 1)


def orders_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Orders as documents, with their items as tabular records; texts as chunks of their own documents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nations = read("nation").select("n_nationkey", "n_name", currency_of(F.col("n_regionkey")).alias("currency"))
    customers = read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "currency")
    orders = read("orders")
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    items = read("lineitem")
    # Items pass by the orders of their partition, each once; sorting them would take the memory of all items.
    money = items.join(known.select("o_orderkey", "currency").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    row = F.concat_ws("/", F.concat(F.lit("fila "), F.col("l_linenumber")), "l_partkey", "l_suppkey")  # a line number alone is not unique here
    number = lambda c: F.col(c).cast(AMOUNT)
    values = union(
        [
            field(orders, "o_orderkey", "Folio", "text", F.concat(F.lit("OC-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), 1),
            field(orders, "o_orderkey", "Estado", "state", F.col("o_orderstatus"), 2),
            field(orders, "o_orderkey", "Fecha", "date", F.col("o_orderdate").cast("date"), 3, day=F.col("o_orderdate").cast("date")),
            field(known, "o_orderkey", "Importe total", "money", number("o_totalprice"), 4, number("o_totalprice"), F.col("currency")),
            field(orders, "o_orderkey", "Cliente", "text", F.concat(F.lit("CL-"), F.col("o_custkey")), 5),
            field(known, "o_orderkey", "Segmento", "text", F.col("c_mktsegment"), 6),
            field(items, "l_orderkey", "Cantidad", "number", number("l_quantity"), 7, number("l_quantity"), scope=row),
            field(money, "l_orderkey", "Precio", "money", number("l_extendedprice"), 8, number("l_extendedprice"), F.col("currency"), scope=row),
            field(items, "l_orderkey", "Descuento", "percentage", F.col("l_discount").cast(AMOUNT), 9, number("l_discount"), scope=row),
            field(items, "l_orderkey", "Retorno", "state", F.col("l_returnflag"), 10, scope=row),
            field(items, "l_orderkey", "Envio", "date", F.col("l_shipdate").cast("date"), 11, day=F.col("l_shipdate").cast("date"), scope=row),
        ]
    )
    name = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit("_pedido.csv"))
    documents = orders.select(
        F.col("o_orderkey").cast("long").alias("document_id"),
        F.concat(F.col("o_orderpriority"), F.lit("/"), name).alias("path"),
        name.alias("title"),
        F.col("o_orderpriority").alias("origin"),
        F.lit("csv").alias("extension"),
        F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast(AMOUNT)), 256).alias("content_hash"),
        F.lit("not_required").alias("ocr_status"),
        F.lit(None).cast("double").alias("ocr_confidence"),
    )
    texts = read("documents")
    chunks = texts.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    unindexed = texts.where("n_chars < 200").select(F.concat("source", F.lit("/"), F.col("doc_id"), F.lit("_texto.txt")).alias("path"), F.col("source").alias("origin"), F.lit("txt").alias("extension"), F.lit("demasiado corto").alias("reason"))
    return Corpus(documents, values, unindexed, chunks)


def with_identifiers(values: DataFrame) -> DataFrame:
    return values.withColumn("identifier_canonical", identifier_of("text_value"))
