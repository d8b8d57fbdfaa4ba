"""The registered queries of the numbered operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import centroids, chat, contamination, lines, merkle, mixing, passages, pii, quality, similarity, tokens, toxicity, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP_LIST = ", ".join(f"'{word}'" for word in quality.STOP_WORDS)

QUALITY_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), win as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (
    select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
), twice as (
  select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1
), rep as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id
), c as (
  select d.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    length(regexp_replace(t, '[^!]+', '', 'g')) as n_exclaims,
    len(list_filter(w, lambda x: lower(x) in ({STOP_LIST}))) as n_stop,
    len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bullets,
    coalesce(rep.n, 0) as n_repeat_words
  from d left join rep using (doc_id)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(word_chars / n_words >= 1.5 and word_chars / n_words <= 14.0, true)
  and coalesce(n_symbols / n_words <= 0.1, true) and coalesce(n_exclaims / n_words <= 0.3, true)
  and coalesce(n_stop / n_words >= 0.01, true) and coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true)
  and coalesce(n_ellipsis / nullif(n_lines, 0) <= 0.5, true) and coalesce(n_bullets / nullif(n_lines, 0) <= 0.9, true) as kept
from b
"""


@query("op4_quality_rules", QUALITY_SQL)
def op4(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_url_filters")
def op8(spark, sf_dir):
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity"
    )


@query("op7_source_mixing")
def op7(spark, sf_dir):
    pieces, documents = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(pieces, documents).select("doc_id", "size", "source", "source_size", "target", "taken")


@query("op10_token_output")
def op10(spark, sf_dir):
    return tokens.token_dataset(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all by name select -7 as conv_id, 0 as turn, 'user' as role, '\### Assistant: </turn> ok' as text
  union all by name select -7 as conv_id, 1 as turn, 'assistant' as role, '\### Assistant: </turn> ok' as text
), e as (
  select *, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') as shown, regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') as named from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(shown) + length(named) + 4 + 2 + 9)::bigint as formatted_chars
from e group by conv_id
"""


@query("op9_chat_formatting", CHAT_SQL)
def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_chats(chat.format_chats(turns.unionByName(extra), vocabulary), vocabulary)


CONTAMINATION_SQL = r"""
with lw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), iw as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), win as (
  select item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from iw where len(w) > 0)
), sizes as (select distinct n from win), grams as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from lw, sizes where len(w) >= n)
), hit as (select doc_id, i, n, item_id from grams join win using (n, g)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from lw left join places using (doc_id) left join found using (doc_id)
"""


@query("op6_decontamination", CONTAMINATION_SQL)
def op6(spark, sf_dir):
    return contamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query("op3_ngram_jaccard_join")
def op3(spark, sf_dir):
    return similarity.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op1_pii_pseudonyms")
def op1(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    return passages.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), l as (
  select rid, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d
), k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key from k where length(key) >= 1 group by key
  having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 10
), m as (select k.*, f.key is not null as gone from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by rid, doc_id
"""


@query("op13_line_dedup", LINES_SQL)
def op13(spark, sf_dir):
    out = lines.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def centroid_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS, dim: int = centroids.DIM) -> str:
    """Plain k-means in DuckDB: distances by brute force, every round its own step."""
    steps = [f"""v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as x from embeddings
  where len(embedding) = {dim} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x::double)))
)""", f"""c0 as (
  select (row_number() over (order by sha256('{centroids.SEED}:' || vec_id::varchar) nulls last, x) - 1)::int as c, x as cx from v
  qualify row_number() over (order by sha256('{centroids.SEED}:' || vec_id::varchar) nulls last, x) <= {k}
)"""]

    def assign(t: int, centres: str) -> str:
        return f"""a{t} as (
  select rid, vec_id, x, first(c order by d, c) as c, first(d order by d, c) as d from (
    select rid, vec_id, x, c, list_sum(list_transform(range(1, {dim + 1}), lambda i: (x[i] - cx[i]) * (x[i] - cx[i]))) as d from v, {centres}
  ) group by rid, vec_id, x
)"""

    for t in range(1, rounds + 1):
        steps.append(assign(t, f"c{t - 1}"))
        steps.append(f"""s{t} as (
  select c, i, sum(x[i]) as s, count(*) as n from a{t}, range(1, {dim + 1}) r(i) group by c, i
), n{t} as (
  select c, list((s - ((s % n) + n) % n) // n order by i) as cx from s{t} group by c
), c{t} as (
  select p.c, coalesce(n{t}.cx, p.cx) as cx from c{t - 1} p left join n{t} using (c)
)""")
    steps.append(assign(rounds + 1, f"c{rounds}"))
    last = f"a{rounds + 1}"
    return "with " + ",\n".join(steps) + f"""
select vec_id, c as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(cx, ',')) as centroid_sha256
from {last} join c{rounds} using (c)
"""


@query("op12_centroid_clustering", centroid_sql())
def op12(spark, sf_dir):
    clustered, _ = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")




def merkle_sql(levels: int = 8, fanout: int = merkle.FANOUT) -> str:
    """The manifest in DuckDB, level by level up to `levels` per tree (fanout^levels leaves a source): crc32 from its rule, trees by grouping."""
    steps = ["crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: "
             "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n)) as t)"]

    def f(x: str) -> str:
        return f"case when {x} is null then '-' else strlen({x}::varchar)::varchar || ':' || {x}::varchar end"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = f"{f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')}"
    steps.append(f"""d as (
  select doc_id, source, sha256({fields} || {f('text')}) as leaf, sha256({fields} || {f(f"translate(text, '{upper}', '{lower}')")}) as tleaf,
    doc_id is not null and xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)),
      lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256), 4294967295), 4294967295) % 5 = 0 as tampered
  from documents, crc
), dp as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from d)""")

    def tree(p: str, base: str) -> None:
        """Levels {p}n0.. of nodes (g, pos, digest) from `base`, counts {p}c.., siblings {p}s.. per node of a group of several."""
        steps.append(f"{p}n0 as ({base})")
        for k in range(levels):
            steps.append(f"""{p}c{k} as (select g, count(*) as n from {p}n{k} group by g),
{p}s{k} as (
  select a.g, a.pos, string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos) as l,
    string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos) as r
  from {p}n{k} a join {p}c{k} c on a.g is not distinct from c.g and c.n > 1
  join {p}n{k} b on a.g is not distinct from b.g and a.pos // {fanout} = b.pos // {fanout}
  group by a.g, a.pos
),
{p}n{k + 1} as (
  select a.g, a.pos // {fanout} as pos, sha256(string_agg(a.digest, '' order by a.pos)) as digest
  from {p}n{k} a join {p}c{k} c on a.g is not distinct from c.g and c.n > 1 group by a.g, a.pos // {fanout}
  union all select a.g, a.pos, a.digest from {p}n{k} a join {p}c{k} c on a.g is not distinct from c.g and c.n = 1
)""")

    tree("x", "select source as g, pos, leaf as digest from dp")
    tree("y", f"select 0 as g, row_number() over (order by g nulls first) - 1 as pos, digest, g as source from xn{levels}")

    def fold(p: str, start: str, key: str, pos: str, g: str) -> str:
        """Per row of `start` (with columns f and proof): folded through the siblings of tree `p`."""
        body = start
        for k in range(levels):
            at = f"{pos} // {fanout ** k}"
            body = f"""select q.* replace (
    case when s.pos is null then q.f else sha256(coalesce(s.l, '') || q.f || coalesce(s.r, '')) end as f,
    q.proof || coalesce(s.l, '') || coalesce(s.r, '') as proof)
  from ({body}) q left join {p}s{k} s on s.g is not distinct from {g} and s.pos = {at}"""
        return body

    leaves = "select doc_id, source, leaf, case when tampered then tleaf else leaf end as f, '' as proof, pos as lpos from dp"
    inner = fold("x", leaves, "doc_id", "q.lpos", "q.source")
    tops = f"select q.*, y.pos as tpos from ({inner}) q join yn0 y on y.source is not distinct from q.source"
    outer = fold("y", tops, "doc_id", "q.tpos", "0")
    return "with " + ",\n".join(steps) + f""",
sub as (select g, digest as subroot from xn{levels}), root as (select digest as root from yn{levels})
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified
from ({outer}) o join sub on sub.g is not distinct from o.source, root
"""


@query("op11_merkle_manifest", merkle_sql())
def op11(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
