"""Queries of this folder's operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.llm import forest
from partslake.llm.language import language
from partslake.llm.mixing import mixing
from partslake.llm.packing import packing
from partslake.llm.ppm import lm_score
from partslake.llm.prefixes import prefix_trie
from partslake.llm.quality import quality
from partslake.llm.repeats import remove_repeats
from partslake.llm.resample import importance_resample
from partslake.llm.secrets import secrets
from partslake.llm.simhash import near_duplicates
from partslake.llm.topk import top_k
from partslake.llm.toxicity import toxicity
from partslake.plans.registry import query, table


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


# The limit on passes in closed form: (largest share / smallest share) ** (1 - t) = 2.
MIXING_SQL = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens,
        cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 3) as int) as block
    from documents
), s as (
    select source, cast(sum(n_tokens) as double) as tokens from d group by source
), p as (
    select source, tokens, tokens / sum(tokens) over () as p from s where tokens > 0
), t as (
    select case when max(p) <= 2 * min(p) then 0 else 1 - ln(2) / ln(max(p) / min(p)) end as t from p
), w as (
    select source, tokens, p, pow(p, t) / sum(pow(p, t)) over () as weight from p, t
), r as (
    select source, tokens, weight, weight / p / min(weight / p) over () as passes from w
    union all select source, tokens, 0, 1 from s where tokens <= 0
), plan as (
    select *, cast(floor(passes + 1e-9) as int) as whole, greatest(0, passes - floor(passes + 1e-9)) * tokens as rest from r
), b as (
    select d.source, block, whole, rest, sum(n_tokens) as tokens,
        md5(concat_ws('|', '0', cast(whole as varchar), coalesce(d.source, ''), cast(block as varchar))) as ord
    from d join plan on d.source is not distinct from plan.source group by d.source, block, whole, rest
), u as (
    select *, sum(tokens) over (partition by source order by ord, block rows unbounded preceding) as upto from b
), e as (
    select d.*, plan.weight, plan.passes, plan.whole, u.upto <= u.rest + 1e-6 and u.rest > 0 as taken,
        u.upto > u.rest + 1e-6 and u.upto - u.tokens < u.rest + 1e-6 as cut, u.rest - (u.upto - u.tokens) as left_over
    from d join plan on d.source is not distinct from plan.source
    join u on u.source is not distinct from d.source and u.block = d.block
), l as (
    select *, sum(n_tokens) over (
        partition by source order by md5(concat_ws('|', '0', cast(whole as varchar), coalesce(cast(doc_id as varchar), ''))), n_tokens
        rows unbounded preceding) as sum_tokens
    from e where cut
), x as (
    select doc_id, source, n_tokens, unnest(range(whole + cast(taken as int))) as pass, block, weight, passes from e
    union all select doc_id, source, n_tokens, whole, block, weight, passes from l where sum_tokens <= left_over + 1e-6
)
select doc_id, source, n_tokens, cast(pass as int) as pass, block, round(weight, 6) as weight, round(passes, 6) as passes from x
"""


@query("op10_mixing", MIXING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "passes")})


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op6_topk",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
        from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select q.vec_id as query_id, c.vec_id,
            cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
        from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
    ), r as (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
    )
    select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_ppm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


@query("op4_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


# The 256 sums of single bytes that a CRC-32 is made of, and the sum of a text ``{x}``.
CRC_BYTES_SQL = """
    select list_transform(range(256), lambda n: list_reduce(
        list_concat([n], range(8)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as sums
"""
CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(
        range(1, octet_length(encode({x})) + 1), lambda i: cast('0x' || substr(hex(encode({x})), 2 * i - 1, 2) as bigint))),
        lambda a, b: xor(a >> 8, sums[(xor(a, b) & 255) + 1])), 4294967295)"""

RESAMPLE_SQL = f"""
with crc as ({CRC_BYTES_SQL}), w as (
    select 0 as side, doc_id, row_number() over () as id, text from documents
    union all select 1, null, row_number() over (), text from benchmark
), words as (
    select side, doc_id, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
    from w
), runs as (
    select side, id, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) as run
    from words, range(1, 4) r(n)
), distinct_runs as (
    select run, {CRC_SQL.format(x="run")} % 10000 as bucket from (select distinct run from runs), crc
), f as (
    select side, id, bucket from runs join distinct_runs using (run)
), c as (
    select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f group by bucket
), g as (
    select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * (sum(s) over () + 10000) / (cast(s + 1 as double) * (sum(t) over () + 10000)))) as bigint) as gain
    from c
), d as (
    select id, count(*) as n_features, sum(gain) as weight from f join g using (bucket) where side = 0 group by id
), scored as (
    select doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
        cast(coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5) / 4294967296.0))) as bigint) as score
    from words left join d using (id) where side = 0
), r as (
    select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
        count(*) filter (n_words >= 20) over () as able
    from scored
)
select doc_id, n_words, n_features, weight, score, case when n_words >= 20 and place <= 5 * able // 100 then place end as rank from r
"""


@query("op12_resample", RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PREFIXES_SQL = f"""
with crc as ({CRC_BYTES_SQL}), t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null
), own as (
    select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, sha256(length(role) || ':' || role || length(text) || ':' || text)) as turns
    from t group by conv_id
), heads as (
    select conv_id, {CRC_SQL.format(x="cast(conv_id as varchar)")} % 6 as h, turns from own, crc
), built as (
    select c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) as turns
    from heads c left join own b on b.conv_id = c.conv_id - c.conv_id % 100
), members as (
    select conv_id, d, turns[1:d] as path, d = len(turns) as ending from built, lateral (select unnest(range(0, len(turns) + 1)) as d)
), nodes as (
    select d, path, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ending), '')) as ends_sha256
    from members group by d, path
), child as (
    select d - 1 as d, path[1:d - 1] as path, count(*) as n_children from nodes where d > 0 group by all
), under as (
    select up as d, path[1:up] as path, count(*) filter (n_children is null) as n_leaves,
        sum(case when d > 0 then (n_convs - 1) * length(path[d].text) else 0 end) as saved_tokens
    from (select n.*, n_children from nodes n left join child using (d, path)), lateral (select unnest(range(0, d + 1)) as up) group by all
)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
    cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n left join child c using (d, path) join under u using (d, path)
left join nodes p on p.d = n.d - 1 and p.path = n.path[1:n.d - 1]
"""


@query("op11_prefixes", PREFIXES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_forest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))
