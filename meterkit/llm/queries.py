"""Registered queries of the training-data operators and their SQL twins.

Each query applies one operator, with production parameters, to whole tables
and derives the digest columns of its result from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.llm import bpe, collocations, credentials, ctw, decontaminate, exact_dedup, importance, near_dedup, preferences, quality, shard, substring_dedup, token_counts

SHARDS = 16
TOKEN_LIMIT = 512


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    out = ctw.score_texts(table(spark, sf_dir, "documents"), train)
    return out.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score", "bits_per_byte")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
with doc as (
    select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (
    select doc_id, i, row_number() over (partition by g order by doc_id, i) as nth
    from (select doc_id, i, array_to_string(w[i:i + 19], ' ') as g
          from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from doc where len(w) >= 20))),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from win where nth > 1),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from doc),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from word anti join gone using (doc_id, p) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc left join kept using (doc_id)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = shard.uniform_shards(table(spark, sf_dir, "documents"), SHARDS, columns={
        "doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(text)})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.withColumnRenamed("id", "doc_id")


OP4_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=3, threshold=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP5_SQL = r"""
with recursive doc as (
    select doc_id, coalesce(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
    from documents),
shingle as (
    select distinct doc_id, s from (
        select doc_id, array_to_string(w[i:i + 2], ' ') as s
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from doc where len(w) > 0))),
size as (select doc_id, count(*) as n from shingle group by 1),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k
         from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select u, v from shared join size a on a.doc_id = u join size b on b.doc_id = v
         where 100 * k >= 85 * (a.n + b.n - k)),
edge as (select u, v from link union all select v, u from link),
walk(doc_id, reached) as (
    select doc_id, doc_id from doc union select w.doc_id, e.v from walk w join edge e on e.u = w.reached)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(reached) as component_id, doc_id = min(reached) as kept
from walk left join size using (doc_id) group by doc_id, n
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return (token_counts.count_tokens(docs, tokenizer_file())
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


#: Score from which a document counts as good.
GOOD = 0.7


def remainder(n: int):
    """crc32 of the doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on ``docs`` and on the labels that may be learnt from."""
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (remainder(4) != 2)).select("doc_id")
    return quality.train(docs, good, remainder(4) != 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"))


OP9_SQL = r"""
with item as (
    select item_id::varchar as item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where text is not null),
gram as (
    select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g
    from (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
          from item where len(w) > 0)),
doc as (
    select doc_id, coalesce(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from documents),
win as (
    select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
          from doc, (select distinct k from gram) where len(w) >= k)),
hit as (select doc_id, i, win.k, item_id from win join gram using (k, g)),
word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by 1),
ids as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items
        from hit group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join word using (doc_id) left join ids using (doc_id)
"""


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.format_pairs(preferences.swapped_answers(table(spark, sf_dir, "conversations")))
    spans = "array_join(transform({0}, x -> concat(x.start, ':', x.length)), ',')"
    return out.select(
        "pair_id", "prompt_turns", "chosen_turns", "rejected_turns",
        *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")),
        *(F.expr(spans.format(c)).alias(c) for c in ("chosen_mask", "rejected_mask")))


OP10_SQL = r"""
with turns as (select conv_id, turn, role, text from conversations where conv_id is not null),
last as (select conv_id, max({'turn': turn, 'text': coalesce(text, '')}) as l from turns where role = 'assistant' group by 1),
ends as (select a.conv_id, a.l, b.l.text as other from last a left join last b on b.conv_id = xor(a.conv_id, 1)),
marked as (
    select t.*, l, other, coalesce(role = 'assistant' and turn is not distinct from l.turn and coalesce(text, '') = l.text, false) as is_last
    from turns t left join ends using (conv_id)),
sides as (
    select conv_id, 'chosen' as side, turn, coalesce(role, '') as role, coalesce(text, '') as text from marked
    union all
    select conv_id, 'rejected', turn, coalesce(role, ''), coalesce(case when is_last then other else text end, '')
    from marked where not is_last or other is not null),
placed as (
    select conv_id, side, role, text, row_number() over (partition by conv_id, side order by turn nulls first, role, text) as i,
           '<|' || role || '|>' || chr(10) as head, replace(text, '<|', '< |') as body
    from sides),
aligned as (
    select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.i, r.i) as i,
           coalesce(c.role = r.role and c.text = r.text, false) as same
    from (from placed where side = 'chosen') c full join (from placed where side = 'rejected') r on c.conv_id = r.conv_id and c.i = r.i),
prefix as (select conv_id, coalesce(min(i) filter (not same) - 1, count(*)) as k from aligned group by 1),
cut as (
    select p.*, k, i > k as after, length(head) + length(body) + 8 as size from placed p join prefix using (conv_id)),
offs as (
    select *, coalesce(sum(size) over (partition by conv_id, side, after order by i rows between unbounded preceding and 1 preceding), 0) as begins
    from cut),
done as (
    select conv_id, any_value(k) as k,
           coalesce(string_agg(head || body || '<|end|>' || chr(10), '' order by i) filter (side = 'chosen' and not after), '') as prompt,
           coalesce(string_agg(head || body || '<|end|>' || chr(10), '' order by i) filter (side = 'chosen' and after), '') as chosen,
           coalesce(string_agg(head || body || '<|end|>' || chr(10), '' order by i) filter (side = 'rejected' and after), '') as rejected,
           coalesce(string_agg((begins + length(head))::bigint || ':' || (length(body) + 7), ',' order by i)
                    filter (side = 'chosen' and after and role = 'assistant'), '') as chosen_mask,
           coalesce(string_agg((begins + length(head))::bigint || ':' || (length(body) + 7), ',' order by i)
                    filter (side = 'rejected' and after and role = 'assistant'), '') as rejected_mask,
           count(*) filter (side = 'chosen' and after) as nc, count(*) filter (side = 'rejected' and after) as nr
    from offs group by 1)
select conv_id as pair_id, k::int as prompt_turns, nc::int as chosen_turns, nr::int as rejected_turns, sha256(prompt) as prompt_sha256,
       sha256(chosen) as chosen_sha256, sha256(rejected) as rejected_sha256, chosen_mask, rejected_mask
from done
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


OP11_SQL = r"""
with word as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
aim as (
    select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as x
    from benchmark),
crc_of_byte as (
    select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
               lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as of),
bucket as (
    select x, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2),
                                  lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                  lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as b
    from (select x, hex(encode(x)) as h from (select unnest(w) as x from word union select x from aim)), crc_of_byte),
used as (select doc_id, unnest(w) as x from word),
s as (select b, count(*) as s from used join bucket using (x) group by 1),
t as (select b, count(*) as t from aim join bucket using (x) group by 1),
gain as (
    select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from used) + 10000)::double
                              / ((s + 1)::double * ((select count(*) from aim) + 10000)::double)))::bigint as g
    from s left join t using (b)),
mean as (select doc_id, floor(sum(g) / count(*))::bigint as weight from used join bucket using (x) join gain using (b) group by 1),
scored as (
    select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double)
                                                      / 4294967296::double)))::bigint as score
    from word left join mean using (doc_id)),
placed as (
    select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n
    from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank
from scored left join placed using (doc_id)
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # by start, then by kind as listed: spans carry the kind's number in front of its name
    kinds = [*credentials.KINDS, *(f"like_{k}" for k in credentials.KINDS)]
    listed = F.transform(F.concat(F.col("base"), F.transform("found", lambda x: F.struct(x.kind, x.start, x.end))), lambda x: F.struct(
        x.start.alias("start"), F.array_position(F.array(*map(F.lit, kinds)), x.kind).alias("nth"), x.kind.alias("kind"), x.end.alias("end")))

    def text(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")

    plain = F.filter(listed, lambda x: x.nth <= len(credentials.KINDS))
    return found.select("doc_id", *map(count, credentials.KINDS),
                        F.sha2(text(plain).cast("binary"), 256).alias("base_sha256"), text(listed).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
with piece as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
    from documents),
run as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
gram as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as g, count(*) as f
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from run, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)
    group by all),
total as (select lang, sum(f)::bigint as n from gram where k = 1 group by 1),
candidate as (select *, string_split(g, ' ') as w from gram where k > 1 and f >= 30),
cut as (
    select lang, c, k, g, f, array_to_string(w[:c], ' ') as g1, array_to_string(w[c + 1:], ' ') as g2
    from (select *, unnest(range(1, k)) as c from candidate)),
scored as (
    select cut.lang, cut.k, cut.g, cut.f as a, arg_min({'l': x.f, 'r': y.f}, [(2000000::hugeint * cut.f) // (x.f + y.f), c]) as lr,
           min((2000000::hugeint * cut.f) // (x.f + y.f)) as score
    from cut join gram x on x.lang = cut.lang and x.g = g1 join gram y on y.lang = cut.lang and y.g = g2 group by all),
around as (
    select lang, array_to_string(w[i:i + m - 1], ' ') as g, max(f) as most
    from (select *, unnest(range(1, k - m + 2)) as i from candidate, (select unnest([2, 3]) as m) where m < k) group by all),
placed as (
    select scored.*, row_number() over (partition by lang order by score desc, a desc, g) as rank
    from scored left join around using (lang, g) where most is null or 100 * most < 80 * a)
select lang, rank, g as phrase, a, lr.l as l, lr.r as r, n, score::bigint as score
from placed join total using (lang) where rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ctw_scoring": op1_ctw_scoring,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_sharding": op3_sharding,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_quality": op8_quality,
        "op9_decontamination": op9_decontamination,
        "op10_preferences": op10_preferences,
        "op11_importance": op11_importance,
        "op12_secrets": op12_secrets,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_near_dedup": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_preferences": OP10_SQL,
            "op11_importance": OP11_SQL, "op13_collocations": OP13_SQL}
