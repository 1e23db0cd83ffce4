"""Registered queries over what the index stores: versions, fields, postings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import near, phrases, ranked
from .operators import relations as rel
from .queries import _LINES, SQL, doubles, query, table_query
from .sources import concepts, covers, identifiers, index, ocr_cache, places, postings, snapshots
from .sources.tables import Corpus, orders_corpus

# ---- the stored inverted index --------------------------------------------------------------------

_BUILT: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> postings.InvertedIndex:
    """The index of a folder's documents, line by line: built by the first question of an application, then read."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _BUILT:
        root = places.work_dir(spark, "postings")
        postings.add(orders_corpus(spark, sf_dir).chunks, root, "s1")
        _BUILT[name] = root
    return postings.open_index(spark, _BUILT[name])


@table_query("J2_postings", rf"with {_LINES}, p as (select document_id, ordinal, unnest(w) as term from lines) select term, count(*)::bigint as tf, count(distinct (document_id, ordinal)) as df, count(distinct document_id) as n_documents from p group by 1")
def j2(spark, d):
    """The dictionary: occurrences, chunks and documents of every term."""
    return stored_index(spark, d).terms.select("term", "tf", "df", "n_documents")


@table_query("J2_blocks", rf"with {_LINES}, p as (select document_id, ordinal, len(w) as length, unnest(w) as term from lines), c as (select term, document_id, ordinal, length, count(*)::int as tf from p group by all) select term, count(*) as n, sum(tf)::bigint as tf, max(tf) as max_tf, min(length)::int as min_length, sum(length)::bigint as length from c group by 1")
def j2_blocks(spark, d):
    """What the blocks hold of each term, and the bounds that they state."""
    whole = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return stored_index(spark, d).blocks.groupBy("term").agg(F.sum("n").alias("n"), whole("tfs").alias("tf"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"), whole("lengths").alias("length"))


@table_query("T6_all_terms", SQL["T6_all_terms"])
def t6(spark, d):
    return ranked.all_terms(stored_index(spark, d), "with thea").select("document_id", F.round("score", 6).alias("score"))


@table_query("T7_free_text", SQL["T7_free_text"])
def t7(spark, d):
    return ranked.free_text(stored_index(spark, d), "with thea license").select("document_id", F.round("score", 6).alias("score"))


# ---- versions of the index ------------------------------------------------------------------------


def _orders(c: Corpus, kept, raised) -> Corpus:
    """The documents of some orders with their document-level money and state; every raised one costs 1 more and has another hash."""
    documents = c.documents.where(kept)
    documents = documents.withColumn("content_hash", F.when(raised, F.concat("content_hash", F.lit("+1"))).otherwise(F.col("content_hash")))
    values = c.values.where("concept in ('Importe total', 'Estado')").where(kept).withColumn("numeric", F.when(raised, F.col("numeric") + 1).otherwise(F.col("numeric")).cast("decimal(24,4)"))
    chunks = documents.select("document_id", F.lit(0).alias("ordinal"), F.col("title").alias("content"))
    return Corpus(documents, values, c.unindexed, chunks)


_VERSIONS = """, v as (select 'v1' as version, id, currency, importe as x from known where id % 3 <> 0
  union all select 'v2', id, currency, importe + case when id % 5 = 0 then 1 else 0 end from known
  union all select 'v3', id, currency, importe + case when id % 5 = 0 then 1 else 0 end from known where id % 7 <> 0),
w as (select * from v union all select 'v4', id, currency, x from v where version = 'v3'),
d as (select 'v1' as version, count_if(id % 3 <> 0)::bigint as added, 0::bigint as modified, 0::bigint as removed from known
  union all select 'v2', count_if(id % 3 = 0)::bigint, count_if(id % 3 <> 0 and id % 5 = 0)::bigint, 0 from known
  union all select 'v3', 0, 0, count_if(id % 7 = 0)::bigint from known union all select 'v4', 0, 0, 0)"""


@query("S17_versions", f"{_VERSIONS} select version, currency, sum(x)::double as value, count(distinct id) as n_documents, added, modified, removed from w join d using (version) group by all")
def s17(c):
    """Orders merged three times, compacted, and each version read back: one in three comes later, one in five changes, one in seven goes."""
    spark = c.documents.sparkSession
    root = places.work_dir(spark, "versions")
    every, changed, ident = F.lit(True), F.col("document_id") % 5 == 0, F.col("document_id")
    index.merge(_orders(c, ident % 3 != 0, ~every), root, "v1")
    index.merge(_orders(c, every, changed), root, "v2")
    index.merge(_orders(c, ident % 7 != 0, changed), root, "v3")
    index.compact(spark, root, "v4")
    parts = []
    for number in snapshots.numbers(spark, root):
        note = snapshots.read(spark, root, number).note
        money = index.load(spark, root, number).values.where("concept = 'Importe total'")
        sums = money.groupBy("currency").agg(F.sum("numeric").cast("double").alias("value"), F.count_distinct("document_id").alias("n_documents"))
        parts.append(sums.select(F.lit(note["name"]).alias("version"), "*", *[F.lit(note.get(k, 0)).cast("long").alias(k) for k in ("added", "modified", "removed")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MARKS = ", m as (select id, origin, 'Estado' as concept, 'state' as kind from known union all select id, origin, 'Marca', case when origin = '5-LOW' then 'number' else 'text' end from known where origin = '5-LOW' or (origin = '1-URGENT' and id % 2 = 0) union all select id, origin, 'Baja', 'text' from known where origin = '5-LOW')"


@query("S20_purge", f"{_MARKS}, c as (select concept, kind, count(*) as n, origin <> '5-LOW' as stays from m group by all), s as (select true as after union all select false) select after, concept, sum(n)::bigint as n_values, first(kind order by n desc, list_position(['money', 'date', 'percentage', 'number', 'state', 'text'], kind)) as kind from (select after, concept, kind, sum(n) as n from c, s where stays or not after group by all) group by 1, 2")
def s20(c):
    """Fields before and after a folder is purged: one changes its kind, one that no document has any more goes."""
    spark, root = c.documents.sparkSession, places.work_dir(c.documents.sparkSession, "purge")
    state = c.values.where("concept = 'Estado'")
    marked = state.drop("concept", "value_type").join(c.documents.select("document_id", "origin"), "document_id")
    low = F.col("origin") == "5-LOW"
    mark = marked.where(low | (F.col("origin") == "1-URGENT") & (F.col("document_id") % 2 == 0)).withColumn("concept", F.lit("Marca")).withColumn("value_type", F.when(low, "number").otherwise("text"))
    gone = marked.where(low).withColumn("concept", F.lit("Baja")).withColumn("value_type", F.lit("text"))
    values = state.unionByName(mark.drop("origin")).unionByName(gone.drop("origin"))
    chunks = c.documents.select("document_id", F.lit(0).alias("ordinal"), F.col("title").alias("content"))
    index.merge(replace(c, values=values, chunks=chunks), root, "v1")
    index.purge_origin(spark, root, "5-LOW", "v2")
    fields = lambda v, after: index.catalogue(spark, root, v).select(F.lit(after).alias("after"), "concept", "n_values", "kind")
    return fields("v1", False).unionByName(fields("v2", True))


# ---- fields and their spellings -------------------------------------------------------------------

_SPELLED = ["Monto total", "Montos totales", "MONTO TOTAL.", "Móntos Totales", "Mont0 t0tal", "Total del monto"]
_LABELS = f"({_SPELLED!r})[id % 6 + 1]"
_READ = f""", r as (select {_LABELS} as label, id % 6 not in (2, 4) as reliable, case when id % 11 = 0 then 'text' else 'money' end as kind, case id % 6 when 4 then 'mont0_t0tal' when 5 then 'total_monto' else 'monto_total' end as key from known),
l as (select key, label, count_if(reliable) as sure, count(*) as n from r group by all),
c as (select key, first(label order by sure desc, n desc, label) as concept, count(*) as n_labels, sum(n)::bigint as n_values from l group by 1),
k as (select key, first(kind order by n desc, list_position(['money', 'text'], kind)) as kind from (select key, kind, count(*) as n from r group by all) group by 1),
f as (select * from c join k using (key))"""


def _spelled(c: Corpus):
    """Order totals under six spellings of a label; two of them are read with doubt."""
    n = (F.col("document_id") % 6).cast("int")
    rows = c.values.where("concept = 'Importe total'").drop("concept").withColumn("label", F.element_at(F.array(*map(F.lit, _SPELLED)), n + 1))
    rows = rows.withColumn("reliable", ~n.isin(2, 4)).withColumn("value_type", F.when(F.col("document_id") % 11 == 0, "text").otherwise("money"))
    return concepts.keyed(rows)


@query("S17_concepts", f"{_READ} select key, concept, kind, n_values, n_labels from f")
def s17_concepts(c):
    return concepts.dictionary(concepts.readings(_spelled(c))).drop("concept_id")


@query("S17_encoded", f"{_READ} select concept, currency, sum(importe)::double as value, count(*) as n from (select case id % 6 when 4 then 'mont0_t0tal' when 5 then 'total_monto' else 'monto_total' end as key, currency, importe from known) join f using (key) group by 1, 2")
def s17_encoded(c):
    """Sums by the field's elected name, whatever each document calls it."""
    values = _spelled(c)
    rows = concepts.encoded(values, concepts.dictionary(concepts.readings(values)))
    return doubles(rows.groupBy("concept", "currency").agg(F.sum("numeric").alias("value"), F.count("*").alias("n")), "value")


@query("P19_concept_lookup", f"{_READ} select name, concept, n_values from f join (values ('los montos totales', 'monto_total'), ('Totales de los montos', 'total_monto'), ('gasto', 'monto_total')) as a(name, key) using (key)")
def p19(c):
    """By another spelling, by an alias, and not by a rejected alias."""
    spark = c.values.sparkSession
    known = concepts.dictionary(concepts.readings(_spelled(c)))
    other = concepts.aliases(spark.createDataFrame([("Monto total", "Gasto", "confirmed"), ("Total del monto", "coste", "rejected")], "label string, other string, status string"))
    asked = spark.createDataFrame([(n,) for n in ("los montos totales", "Totales de los montos", "gasto", "coste", "nada")], "name string")
    return concepts.lookup(asked, known, other).select("name", "concept", "n_values")


# ---- near values ----------------------------------------------------------------------------------

_TEXTS = ", t as (select distinct 'Folio' as concept, 'oc-' || lpad(id::varchar, 7, '0') as text from known union select distinct 'Cliente', 'cl-' || o_custkey from known union select distinct 'Segmento', lower(segmento) from known)"
_SLIPS = _TEXTS + ", a as (select concept, left(text, length(text) // 2) || substr(text, length(text) // 2 + 2) as asked from t union select concept, text || 's' from t)"


def _texts(c: Corpus):
    return c.values.where("concept in ('Folio', 'Cliente', 'Segmento') and literal_value is not null").select("concept", F.col("literal_value").alias("text")).distinct()


@query("F16_misspelled", f"{_SLIPS} select concept, asked, text, levenshtein(asked, text)::int as distance from a join t using (concept) where levenshtein(asked, text) <= 1")
def f16_misspelled(c):
    """All values of the text fields, and what one slip from each of them could have meant: a letter lost in the middle, or one too many."""
    texts = _texts(c)
    half = F.floor(F.length("text") / 2).cast("int")
    lost = F.concat(F.substring("text", F.lit(1), half), F.substring("text", half + 2, F.length("text")))
    more = F.concat("text", F.lit("s"))
    # Both from one pass over the texts: so either side of the join reads the same rows, which are made distinct once.
    return near.near(texts.select("concept", F.explode(F.array(lost, more)).alias("text")), texts, ["concept"], 1)


_DOUBTFUL = ", d as (select segmento as concept, case when id % 10 = 0 then overlay_text else 'oc-' || lpad(id::varchar, 7, '0') end as text, id % 10 <> 0 as sure from (select *, 'oc-' || lpad(id::varchar, 6, '0') as overlay_text from known)), s as (select concept, text, bool_or(sure) as sure, count(*) as n from d group by 1, 2)"


@query("F18_spellings", f"{_DOUBTFUL} select o.concept, o.text as variant, first(k.text order by levenshtein(o.text, k.text), k.n desc, k.text) as literal_value from s o join s k on o.concept = k.concept and not o.sure and k.sure and levenshtein(o.text, k.text) <= 1 group by 1, 2")
def f18_spellings(c):
    """Order numbers by segment, one in ten read with a digit lost: what each such reading stands for, if anything sure is near."""
    short = F.concat(F.lit("oc-"), F.lpad(F.col("document_id").cast("string"), 6, "0"))
    doubt = F.col("document_id") % 10 == 0
    folio = c.values.where("concept = 'Folio'").withColumn("literal_value", F.when(doubt, short).otherwise(F.col("literal_value"))).withColumn("reliable", ~doubt)
    segment = c.values.where("concept = 'Segmento'").select("document_id", F.col("text_value").alias("segment"))
    rows = folio.drop("concept").join(segment, "document_id").withColumnRenamed("segment", "concept")
    return near.spelling_variants(rows)


# ---- many questions at once -----------------------------------------------------------------------

_ASKED = ", q as (select id as question_id, 'oc ' || lpad(id::varchar, 7, '0') as folio, 'cl ' || o_custkey as cliente, lower(segmento) as segmento, id % 3 as k from known where id % 4 = 0)"


def _questions(c: Corpus):
    """One in four orders asked about: by number, customer and segment; by customer and segment; by segment alone."""
    wide = c.values.where("concept in ('Folio', 'Cliente', 'Segmento')").groupBy("document_id").agg(*[F.max(F.when(F.col("concept") == n, F.col("text_value"))).alias(n) for n in ("Folio", "Cliente", "Segmento")]).where("document_id % 4 = 0")
    k = F.col("document_id") % 3
    return wide.select(F.col("document_id").alias("question_id"), F.concat(F.lit("¿Qué pasó con "), F.when(k == 0, F.concat("Folio", F.lit(" de "))).otherwise(""), F.when(k < 2, F.concat("Cliente", F.lit(", "))).otherwise(""), "Segmento", F.lit("?")).alias("text"))


@query("F20_questions", f"{_ASKED} select question_id, 'Folio' as concept, replace(folio, ' ', '-') as literal_value from q where k = 0 union all select question_id, 'Cliente', replace(cliente, ' ', '-') from q where k < 2 union all select question_id, 'Segmento', segmento from q")
def f20_questions(c):
    return phrases.covered(phrases.mentioned(_questions(c), c.values)).select("question_id", "concept", "literal_value")


@query("F22_questions", f"{_ASKED}, n as (select o_custkey, count(*) as n, min(id) as low from known group by 1), m as (select segmento, count(*) as n, min(id) as low from known group by 1) select question_id, case when k = 0 then question_id when k = 1 and n.n = 1 then n.low when k = 2 and m.n = 1 then m.low end as document_id, case k when 0 then 3008 when 1 then 2005 else 1002 end::bigint as score, (3 - k)::int as n_anchors, case k when 0 then 1 when 1 then n.n else m.n end as n_tied from q join known on id = question_id join n using (o_custkey) join m on m.segmento = known.segmento")
def f22_questions(c):
    """The order that each question describes; a customer's several orders tie, and then none is pinned."""
    return phrases.pinned(_questions(c), c.values.where("concept in ('Folio', 'Cliente', 'Segmento')"))


_FILTERS = ", q as (select id, estado, segmento, id % 3 as k from known where id % 4 = 0)"


@query("F17_inferred", f"{_FILTERS} select id as question_id, 'Cliente' as concept, null::varchar as literal_value, 'asked' as how from q where k = 0 union all select id, 'Estado', lower(estado), case k when 0 then 'explicit' else 'implicit' end from q where k <> 1 union all select id, 'Segmento', lower(segmento), 'explicit' from q where k = 0 union all select id, 'Urgente', case k when 1 then 'si' else 'no' end, 'binary' from q where k > 0 union all select id, 'Importe total', null, 'asked' from q where k = 2 union all select id, 'Retorno', null, 'unapplied' from q where k = 2")
def f17(c):
    """Conditions of one question for each fourth order: named, said alone, by yes and no, asked for, and lost; a single word that is no state is none."""
    urgent = F.when(F.col("origin") == "1-URGENT", "sí").otherwise("no")
    state = c.values.where("concept = 'Estado'")
    flags = state.join(c.documents.select("document_id", "origin"), "document_id").withColumn("text_value", urgent).withColumn("literal_value", F.translate(urgent, "í", "i")).withColumn("concept", F.lit("Urgente")).drop("origin")
    values = c.values.where("concept in ('Cliente', 'Estado', 'Importe total', 'Retorno', 'Segmento')").unionByName(flags)
    wide = c.values.where("concept in ('Estado', 'Segmento') and document_id % 4 = 0").groupBy("document_id").agg(*[F.max(F.when(F.col("concept") == n, F.col("text_value"))).alias(n) for n in ("Estado", "Segmento")])
    k = F.col("document_id") % 3
    full = F.concat(F.lit("¿Cuál es el Cliente de los pedidos con Estado "), "Estado", F.lit(" y Segmento "), "Segmento", F.lit("?"))
    flag = F.concat(F.lit("¿Cuántos pedidos urgente hay en "), "Segmento", F.lit("?"))
    lost = F.concat(F.lit("Suma del importe total de los pedidos sin urgente, con retorno y "), "Estado")
    asked = wide.select(F.col("document_id").alias("question_id"), F.when(k == 0, full).when(k == 1, flag).otherwise(lost).alias("text"))
    return phrases.inferred_filters(asked, values)


# ---- identifiers in texts -------------------------------------------------------------------------

_IDS = r", i as (select distinct doc_id as document_id, regexp_replace(lower(strip_accents(token)), '[-_/.]', '', 'g') as identifier from (select doc_id, unnest(regexp_extract_all(text, '[\pL\pN]+(?:[-_/.][\pL\pN]+)*')) as token from documents) where regexp_matches(token, '\pL') and regexp_matches(token, '\pN'))"
_WANTED = [("exact", "mail2.example.com"), ("prefix", "MAIL2"), ("contains", "l2.exam")]


@query("F8_in_text", _IDS + " select 'exact' as mode, document_id, 140 as score from i where identifier = 'mail2examplecom' union all select distinct 'prefix', document_id, 130 from i where starts_with(identifier, 'mail2') union all select distinct 'contains', document_id, 130 from i where contains(identifier, 'l2exam')")
def f8_in_text(c):
    """From the stored identifiers of all texts: the identifier itself, its beginning, and what it contains."""
    spark = c.chunks.sparkSession
    root = places.work_dir(spark, "identifiers")
    identifiers.save(c.chunks, root)
    parts = [identifiers.find(spark, root, w, mode).select(F.lit(mode).alias("mode"), "document_id", "score") for mode, w in _WANTED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- all keys and all fields ----------------------------------------------------------------------

_STATED = """, k as (select 'Folio' as key_field, 'oc' || lpad(id::varchar, 7, '0') as key, id from known union all select 'Cliente', 'cl' || o_custkey, id from known),
e as (select id, 'Folio' as concept, 'oc-' || lpad(id::varchar, 7, '0') as x from known union all select id, 'Cliente', 'cl-' || o_custkey from known union all select id, 'Estado', lower(estado) from known
  union all select id, 'Fecha', fecha::varchar from known union all select id, 'Importe total', importe::varchar from known union all select id, 'Segmento', lower(segmento) from known
  union all select id, 'Cantidad', cantidad::varchar from items union all select id, 'Precio', precio::varchar from items union all select id, 'Descuento', descuento::varchar from items
  union all select id, 'Retorno', lower(retorno) from items union all select id, 'Envio', envio::varchar from items),
f as (select id, concept, case when min(x) = max(x) then min(x) end as value from e group by 1, 2),
s as (select key_field, key, count(*) as n_linked from k group by 1, 2 having count(*) > 1),
j as (select key_field, key, concept, value, n_linked from k join s using (key_field, key) join f using (id))"""


@query("C6_all", f"{_STATED} select key_field, key, concept, count(distinct value) as n_values, count(*) as n_documents, min(value) as low, max(value) as high, true as reliable from j where value is not null and concept <> key_field group by 1, 2, 3 having count(distinct value) > 1")
def c6_all(c):
    """Every contradiction of the collection in one pass."""
    return rel.all_contradictions(c.values)


@query("C7_all", f"{_STATED}, g as (select key_field, key, n_linked, concept from s, (select distinct concept from e)), d as (select key_field, key, concept, count(*) as n, count(distinct value) as v, count_if(value is null) as m from j group by 1, 2, 3) select key_field, key, concept, n_linked, coalesce(n, 0) as n_documents, coalesce(v, 0) as n_values, coalesce(m, 0)::bigint as n_several, n_linked - coalesce(n, 0) as n_gaps, coalesce(v, 0) > 1 as conflict, true as reliable from g left join d using (key_field, key, concept)")
def c7_all(c):
    """The dossier of every shared key, over all fields."""
    return rel.all_dossiers(c.values)


# ---- covers and OCR -------------------------------------------------------------------------------

_COVER = r"""with l as (select doc_id, generate_subscripts(x, 1) - 1 as line, unnest(x) as text from (select doc_id, regexp_split_to_array(text, '\r\n|\r|\n') as x from documents)),
w as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from l),
v as (select label from (select doc_id, w[1] as label from w where len(w) > 0 union all select doc_id, w[1] || ' ' || w[2] from w where len(w) > 1) where regexp_matches(label, '^\s*\pL') and not regexp_matches(label, '\s\p{Lu}') group by 1 having count(distinct doc_id) >= 2),
h as (select doc_id, line, w, text, regexp_matches(text, '^[^:]{1,120}:\s*\S') as own, case when array_to_string(w, ' ') in (select label from v) then 0 when len(w) > 2 and w[1] || ' ' || w[2] in (select label from v) then 2 when len(w) > 1 and w[1] in (select label from v) then 1 else 0 end as k from w),
r as (select *, count(*) over (partition by doc_id, island) as n from (select *, line - row_number() over (partition by doc_id order by line) as island from h where k > 0 or own))
select doc_id as document_id, line::int as line, array_to_string(w[:k], ' ') as label, sha256(array_to_string(w[k + 1:], ' ')) as value from r where n >= 3 and k > 0 and not own"""


@table_query("S13_covers", _COVER)
def s13(spark, d):
    """Lines of all texts by labels that the texts themselves begin their lines with: one word or two, in two documents at least."""
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.col("text").alias("content"))
    lines = texts.select("document_id", F.explode(F.split("content", r"\r\n|\r|\n")).alias("line")).select("document_id", F.array_remove(F.split("line", r"\s+"), "").alias("w"))
    starts = F.filter(F.array(F.element_at(F.slice("w", 1, 1), 1), F.when(F.size("w") > 1, F.array_join(F.slice("w", 1, 2), " "))), lambda x: x.isNotNull())
    heads = lines.where(F.size("w") > 0).select("document_id", F.explode(starts).alias("concept"), F.lit(True).alias("reliable"))
    found = covers.cover_lines(texts, covers.vocabulary(heads))
    return found.select("document_id", "line", "label", F.sha2("value", 256).alias("value"))


def _shown(content: bytes) -> tuple[str, float]:
    """Stands for an OCR engine: what a page begins with, surer for longer pages."""
    return content[:24].decode("utf-8", "ignore"), len(content) % 100 / 100


@table_query("S15_ocr_cache", "with h as (select page_id, sha256(html) as content_hash, octet_length(encode(html)) % 100 / 100 as confidence, page_id % 2 = 0 as early from pages where html is not null) select page_id, content_hash, case when confidence >= 0.55 then 'complete' else 'low_confidence' end as status, case when bool_or(early) over (partition by content_hash) then 'first' else 'second' end as batch from h")
def s15(spark, d):
    """Half of the pages, then all: the second run reads only what the first has not, and equal contents once."""
    pages = spark.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", F.col("html").cast("binary").alias("content"))
    root = places.work_dir(spark, "ocr")
    ocr_cache.recognise(pages.where("page_id % 2 = 0"), _shown, root, "first")
    return ocr_cache.recognise(pages, _shown, root, "second").select("page_id", "content_hash", "status", "batch")
