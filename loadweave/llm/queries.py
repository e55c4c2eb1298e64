"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import (
    bpe, clusters, decontaminate, fill_in_middle, language_id, line_dedup, pii, pitman_yor, sentence_pieces, simhash, token_files,
    top_k, toxicity,
)
from loadweave.llm.common import crc_mod, table
from loadweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Where the tokenizer file lies on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: Keys the surrogates of the registered query; a real run passes a secret of its own.
SURROGATE_KEY = "registered query"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sha256(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


ORACLE["op2_top_k"] = """
with good as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    vectors = table(spark, sf_dir, "embeddings").where(usable).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("vector"))
    return top_k.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    model, pairs = pitman_yor.fit(docs.where(~held_out))
    return pitman_yor.score(docs, model, pairs).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.filter("items", F.isnotnull)).cast("array<string>"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        sha256(F.array_join(names, ",")).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, SURROGATE_KEY).select("doc_id", "n_entities", "text")


ORACLE["op9_line_dedup"] = r"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from texts),
trimmed as (select doc_id, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from lines),
keyed as (select doc_id, i, line, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from trimmed),
owners as (select k, min(doc_id) as owner from keyed where length(k) >= 10 group by k),
marked as (select keyed.*, owner is not null and owner < doc_id as gone from keyed left join owners using (k))
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return token_files.read_ids(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds unrolled. Products of such small integers are exact in doubles."""
    steps = ["""good as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""c0 as (select cast(row_number() over (order by h) - 1 as integer) as c, v
  from (select sha256('2:' || vec_id) as h, v from good order by h limit {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as (select vec_id, any_value(v) as v, min(cast(d as bigint) * {k} + c) as found from
  (select g.vec_id, g.v, c.c, list_dot_product(g.v, g.v) - 2 * list_dot_product(g.v, c.v) + list_dot_product(c.v, c.v) as d
   from good g cross join c{r} c) group by vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} as (select c, list(m order by i) as v from (select found % {k} as c, i, floor(sum(x) / count(*)) as m
  from (select found, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by found % {k}, i) group by c)""")
            steps.append(f"c{r + 1} as (select o.c, coalesce(m.v, o.v) as v from c{r} o left join m{r} m using (c))")
    steps.append(f"placed as (select vec_id, cast(found % {k} as integer) as cluster, found // {k} as distance from a{rounds})")
    steps.append(f"""named as (select c, sha256(array_to_string(list_transform(v, lambda x: cast(cast(x as bigint) as varchar)), ',')) as s
  from c{rounds})""")
    return "with " + ",\n".join(steps) + """
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, s as centroid_sha256
from placed join named on cluster = c
"""


ORACLE["op11_clusters"] = _clusters_sql()


@query
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"), dim=64, k=40, rounds=5, seed=2, scale=256)
    digest = sha256(F.concat_ws(",", F.col("centroid").cast("array<string>")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


@query
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL, decoded="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_hash"))


ORACLE["op13_fill_in_middle"] = r"""
with h as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as x from documents),
u as (select *, regexp_extract_all(t, E'[^\n]*\n|[^\n]+') as l, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2,
  cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from h),
c as (select *, len(l) as n, h1 % (len(l) + 1) as a, h2 % (len(l) + 1) as b from u),
p as (select *, array_to_string(l[1:least(a, b)], '') as p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') as m,
  array_to_string(l[greatest(a, b) + 1:], '') as s,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
       when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
         else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from p
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line", seed=7, percent=100,
                                       spm_percent=50)
    back = fill_in_middle.restore(changed)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"),
                       sha256(F.col("restored")).alias("restored_sha256"))
