"""The operators' queries: each applies an operator with production parameters to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, convtrie, exactdup, fmindex, html_text, minhash, mixing, nndescent, rpforest, runs, sharding, tokens, toxicity
from .common import shared_dir, table


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents")).drop("group")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on 4-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=80, shingle=4)


def op2_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents once 13-word windows of earlier documents are gone."""
    return fmindex.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op3_rp_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate vectors within each label."""
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to."""
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as range-coded files and read back."""
    import public_tokenizers

    out = f"{shared_dir(spark)}/codefacts/token-ids-{uuid.uuid4().hex}"
    tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out, end_id=2)
    return tokens.read(spark, out)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return nndescent.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents, and the row of each that stays."""
    return exactdup.deduplicate(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return convtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of all documents, a tenth of them made periodic."""
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_fm_substring_dedup": op2_fm_substring_dedup,
    "op3_rp_forest_dedup": op3_rp_forest_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_files": op5_token_files,
    "op6_shard_documents": op6_shard_documents,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_pu_toxicity": op8_pu_toxicity,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_page_text": op10_page_text,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Words of every document with their places; windows and shingles are lists of words.
_WORDS = r"""w as (select doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') as ws from documents)"""

#: Smallest id that links lead to, by walking them; fixed point of a recursive union.
_REACH = """reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)"""

#: Unsigned crc32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({text}, '')]), lambda crc, x: case when x >= 0 then xor(crc, x::bigint)
    else xor(crc >> 1, (crc & 1) * 3988292384) end, 4294967295::bigint), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, row_number() over (w order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op12_conversation_trie": f"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as x from conversations where conv_id is not null),
        c as (select conv_id, list(x order by pos) as turns, {_CRC32.format(text="conv_id::varchar")} % 6 as h from t group by conv_id),
        r as (select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns from c left join c b on b.conv_id = c.conv_id - c.conv_id % 100),
        p as (select conv_id, turns[1:d] as prefix, d, d = len(turns) as ends from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from r)),
        n as (select prefix, any_value(d) as d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '') as ends from p group by prefix),
        k as (select n.*, m.conv_id as parent_conv_id from n left join n m on n.d > 0 and m.prefix = n.prefix[1:n.d - 1]),
        kids as (select prefix[1:d - 1] as prefix, count(*) as kids from n where d > 0 group by all),
        own as (select k.*, coalesce(kids, 0) as n_children, case when k.d > 0 then (n_convs - 1) * length(k.prefix[k.d].text) else 0 end as saves from k left join kids on kids.prefix = k.prefix),
        sums as (select prefix[1:e] as prefix, count(*) filter (n_children = 0) as n_leaves, sum(saves)::bigint as saved_tokens from (select prefix, n_children, saves, unnest(range(d + 1)) as e from own) group by all)
        select conv_id, d as depth, parent_conv_id, n_convs, n_children::bigint as n_children, n_leaves, saved_tokens, sha256(ends) as ends_sha256 from own join sums using (prefix)""",
    "op2_fm_substring_dedup": f"""
        with {_WORDS.format(text="coalesce(text, '')")},
        windows as (select doc_id, k, ws[k + 1:k + 13] as win from (select doc_id, ws, unnest(range(len(ws) - 12)) as k from w where len(ws) >= 13)),
        firsts as (select win, min(doc_id) as lo from windows group by win),
        gone as (select distinct doc_id, k + j as pos from (select doc_id, k from windows join firsts using (win) where lo < doc_id), (select unnest(range(13)) as j)),
        words as (select doc_id, unnest(range(len(ws))) as pos, unnest(ws) as word from w),
        kept as (select x.doc_id, count(g.pos) as n_removed, string_agg(case when g.pos is null then word end, ' ' order by x.pos) as kept from words x left join gone g on x.doc_id = g.doc_id and x.pos = g.pos group by x.doc_id)
        select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op3_rp_forest_dedup": f"""
        with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where embedding is not null and label is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
        links as (select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id <> q.vec_id and len(p.x) = len(q.x) and list_cosine_similarity(p.x, q.x) >= 0.98), {_REACH},
        n as (select a, count(*) as n from links group by a), c as (select a, min(b) as c from reach group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(c, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c, vec_id)) as kept
        from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id""",
    "op9_minhash_dedup": f"""
        with recursive {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
        sets as (select distinct doc_id, g from (select doc_id, ws[k + 1:k + 4] as g from (select doc_id, ws, unnest(range(len(ws) - 3)) as k from w where len(ws) >= 4) union all select doc_id, ws from w where len(ws) between 1 and 3)),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        common as (select p.doc_id as a, q.doc_id as b, count(*) as c from sets p join sets q on p.g = q.g and p.doc_id <> q.doc_id group by all),
        links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)), {_REACH},
        m as (select a, min(b) as c from reach group by a)
        select w.doc_id, coalesce(n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) as component_id, w.doc_id = least(w.doc_id, coalesce(m.c, w.doc_id)) as kept
        from w left join sizes using (doc_id) left join m on m.a = w.doc_id""",
}
