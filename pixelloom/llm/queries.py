"""The queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, fingerprint, neardup, packing, pii, secretscan, substring, suffixmerge, toxicity, urlfilter, vectorcode, warc
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bw as (
  select distinct item_id, array_to_string(w[i : i + 12], ' ') as g, least(13, len(w)) as k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
), dw as (
  select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)
), hit as (
  select doc_id, i, dw.k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k
), covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from hit)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as g
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
), rep as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as nth from win) where nth > 1
), gone as (
  select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from rep)
), word as (
  select doc_id, p, w[p] as t from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)
), kept as (
  select doc_id, string_agg(t, ' ' order by p) as text, count(*) as n from word anti join gone using (doc_id, p) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_with_edits(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint.printed(F.col("packed")).alias("fingerprint"), fingerprint.printed(F.col("packed_edited")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(read(spark, sf_dir, "documents"), secretscan.example_findings(spark))
    return found.withColumnRenamed("id", "doc_id")


def pii_key(spark: SparkSession) -> str:
    """The key of the surrogates; the one here is for the invented people of the test tables only."""
    return spark.conf.get("spark.pixelloom.pii.key", "key for test tables")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), mentions_col="mentions")
    return found.select(
        "doc_id", "text", F.size("mentions").cast("long").alias("n_entities"), F.transform("mentions", lambda m: m["kind"]).alias("kinds"), F.transform("mentions", lambda m: m["surrogate"]).alias("surrogates")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP8_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, md5(array_to_string(w[i : i + 3], ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), few as (
  select g from s group by g having count(*) > 1
), t as (
  select doc_id, g from s join few using (g)
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from t x join t y on x.g = y.g and x.doc_id < y.doc_id group by all
), link as materialized (
  select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)
), edge as materialized (
  select a, b from link union all select b, a from link
), reach as (
  select doc_id as a, doc_id as b from d
  union
  select reach.a, edge.b from reach join edge on reach.b = edge.a
), least_id as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join least_id using (doc_id)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.load(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), h as (
  select page_id, octet_length(payload) as n, sha1(payload) as hex from p
), g as (
  select page_id, n, hex, list_transform(range(8), lambda i: cast('0x' || substr(hex, cast(i as int) * 5 + 1, 5) as int)) as v from h
), f as (
  select hex, min(page_id) as first_id from h group by hex
)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(v, lambda x: substr(a, 1 + (x >> 15), 1) || substr(a, 1 + ((x >> 10) & 31), 1) || substr(a, 1 + ((x >> 5) & 31), 1) || substr(a, 1 + (x & 31), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from g join f using (hex), (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as a)
"""


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixmerge.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Hexadecimal digits stand for the bytes; strings are cut from blocks, since cutting them from whole texts takes their length each time.
OP11_SQL = """
with d as materialized (
  select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents
), block as (
  select doc_id, b, substr(h, 2 * b + 1, 2198) as part, least(n - b - 99, 1000) as k from (select *, unnest(range(0, greatest(n - 99, 0), 1000)) as b from d)
), win as (
  select doc_id, b + i as s, md5(substr(part, 2 * i + 1, 200)) as g from (select *, unnest(range(0, k)) as i from block)
), rep as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as nth from win) where nth > 1
), edge as (
  select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end as new from rep
), island as (
  select doc_id, min(s) as a, max(s) + 100 as e from (select doc_id, s, sum(new) over (partition by doc_id order by s) as k from edge) group by doc_id, k
), piece as (
  select doc_id, a, e, substr(h, 2 * prev + 1, 2 * (a - prev)) as part
  from (select *, coalesce(lag(e) over (partition by doc_id order by a), 0) as prev from island) join d using (doc_id)
), front as (
  select doc_id, string_agg(part, '' order by a) as front, max(e) as e, sum(e - a) as removed, count(*) as spans from piece group by doc_id
)
select d.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(e, 0) + 1))) as kept_sha256
from d left join front using (doc_id)
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), word as (
  select id, lang, source, unnest(w) as term from d
), dictionary as (
  select lang, term from word group by lang, term having count(distinct id) >= 10
), occurs as (
  select lang, source, term, count(*) as n from word join dictionary using (lang, term) group by all
), g as (
  select distinct lang, source from d
), v as (
  select lang, count(*) as v from dictionary group by lang
), own as (
  select lang, source, term, coalesce(n, 0) as n, v, sum(coalesce(n, 0)) over (partition by lang, source) as total
  from g join dictionary using (lang) join v using (lang) left join occurs using (lang, source, term)
), p as (
  select lang, source, term, n, cast(1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v) as bigint) as p from own
), whole as (
  select lang, term, sum(n) as n, any_value(v) as v from own group by lang, term
), q as (
  select lang, term, cast(1 + (1000000000::hugeint * (n + 2)) // ((sum(n) over (partition by lang)) + 2 * v) as bigint) as q from whole
), sums as (
  select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
), pair as (
  select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(value, 0) as bigint) as value
  from g x join g y on x.lang = y.lang and x.source <> y.source left join sums on sums.lang = x.lang and sums.source = x.source and sums.item = y.source
), term as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
where part = 'pair' or rank <= 10
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcode.coded(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_sql() -> str:
    """Rounds written out one after the other; a part's four components are columns."""
    tables = [r"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0
), part as materialized (
  select vec_id, label, p, v[4 * p + 1] as x0, v[4 * p + 2] as x1, v[4 * p + 3] as x2, v[4 * p + 4] as x3 from (select *, unnest(range(16)) as p from kept)
), book0 as materialized (
  select p, e, x0, x1, x2, x3 from part join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept) using (vec_id) where e < 64
)"""]
    floored = lambda k: f"(sum(t.x{k}) - ((sum(t.x{k}) % count(*)) + count(*)) % count(*)) // count(*)"
    for r in range(3):
        square = " + ".join(f"(t.x{k} - b.x{k}) * (t.x{k} - b.x{k})" for k in range(4))
        tables.append(f"near{r} as materialized (select t.vec_id, t.p, min(row({square}, b.e)) as best from part t join book{r} b using (p) group by all)")
        tables.append(f"code{r} as materialized (select vec_id, p, best[1] as d, best[2] as e from near{r})")
        if r < 2:
            moved = ", ".join(f"{floored(k)} as x{k}" for k in range(4))
            tables.append(f"mean{r} as (select c.p, c.e, {moved} from code{r} c join part t using (vec_id, p) group by c.p, c.e)")
            tables.append(f"book{r + 1} as materialized (select b.p, b.e, " + ", ".join(f"cast(coalesce(m.x{k}, b.x{k}) as bigint) as x{k}" for k in range(4)) + f" from book{r} b left join mean{r} m using (p, e))")
    return ",\n".join(tables) + """,
digest as (
  select sha256(string_agg(x0 || ',' || x1 || ',' || x2 || ',' || x3, ',' order by p, e)) as codebooks_sha256 from book2
), own as (
  select vec_id, string_agg(printf('%02x', cast(e as int)), '' order by p) as code, cast(sum(d) as bigint) as error from code2 group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from own join kept using (vec_id), digest
"""


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op4_url_filter": op4_url_filter,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_secret_scan": op6_secret_scan,
        "op7_pii": op7_pii,
        "op8_near_dedup": op8_near_dedup,
        "op9_warc": op9_warc,
        "op10_toxicity": op10_toxicity,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_source_divergence": op12_source_divergence,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op2_substring_dedup": OP2_SQL,
        "op4_url_filter": urlfilter.sql(),
        "op8_near_dedup": OP8_SQL,
        "op9_warc": OP9_SQL,
        "op11_suffix_dedup": OP11_SQL,
        "op12_source_divergence": OP12_SQL,
        "op13_vector_codes": op13_sql(),
    }
