"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.llm import alignment, collocations, covertree, lm, maxscore, mixing, packing, repeats, secrets, sharding, simhash, toxicity, warc
from truegauge.llm.shared import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The vocabulary that the packing contract names, and the two that are aligned.
TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op8_simhash_near_duplicates")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_best_fit_packing")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op6_warc",
    """
    with page as (
        select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as last from pages
    )
    select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
           case when strlen(html) >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
           case when strlen(html) >= 1000 and page_id <> last then last end as refers_to
    from page
    """,
)
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query(
    "op2_cover_tree_near_duplicates",
    """
    with recursive v as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e
        from embeddings
        where label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    link as (
        select a.vec_id as a, b.vec_id as b
        from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
        where list_cosine_similarity(a.e, b.e) >= 0.98
    ),
    reach as (
        select a, b from link
        union
        select r.a, l.b from reach r join link l on r.b = l.a
    ),
    counts as (select a, count(*) as n from link group by a),
    lowest as (select a, min(b) as low from reach group by a)
    select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
           vec_id = least(vec_id, coalesce(low, vec_id)) as kept
    from embeddings left join counts on vec_id = counts.a left join lowest on vec_id = lowest.a
    """,
)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op5_maxscore_top_k",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as t
        from embeddings
        where embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    pair as (
        select q.vec_id as query_id, c.vec_id,
               cast(list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) as bigint) as score
        from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
    ),
    ranked as (
        select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pair
    )
    select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
)
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_deleted_interpolation_scores")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


@query("op1_string_kernel_toxicity")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_secret_findings")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "start", "length", F.sha2("candidate", 256).alias("sha256"), F.round("score", 6).alias("score"))


@query(
    "op7_repeated_passages",
    r"""
    with part as (
        select doc_id, parts[i] as part, i
        from (
            select doc_id, parts, unnest(generate_series(1, len(parts))) as i
            from (
                select distinct doc_id, text,
                       string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(30), 'g'), chr(30)) as parts
                from documents
            )
        )
    ),
    placed as (
        select doc_id, i, part, length(part) as length,
               coalesce(sum(length(part)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start,
               list_filter(string_split_regex(lower(part), '[\t\n\v\f\r ]+'), lambda w: w <> '') as words
        from part
    ),
    unit as (
        select doc_id, start, length, len(words) as words, array_to_string(words, ' ') as body,
               row_number() over (partition by doc_id order by i) as unit
        from placed where len(words) > 0
    ),
    ranked as (
        select *, row_number() over (partition by body order by doc_id, unit) as nth,
               first_value(doc_id) over (partition by body order by doc_id, unit) as kept_doc_id,
               first_value(start) over (partition by body order by doc_id, unit) as kept_start
        from unit
    ),
    later as (
        select *, unit - row_number() over (partition by doc_id order by unit) as run from ranked where nth > 1
    )
    select doc_id, cast(start as bigint) as start, length, cast(words as integer) as words,
           kept_doc_id, cast(kept_start as bigint) as kept_start
    from (select *, sum(words) over (partition by doc_id, run) as run_words from later)
    where run_words >= 20
    """,
)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = repeats.removed_units(table(spark, sf_dir, "documents"))
    return gone.select(F.col("key").alias("doc_id"), "start", "length", "words", F.col("kept_key").alias("kept_doc_id"), "kept_start")


@query("op9_pfair_mixing")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def alignment_digests(found: DataFrame) -> DataFrame:
    """Alignments with the SHA-256 of their groups in place of the groups; '' without any."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("op11_tokenizer_alignment")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [tokenizer_path(n) for n in ALIGNED]
    return alignment_digests(alignment.alignments(table(spark, sf_dir, "documents"), *paths))


@query("op13_differencing_shards")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op12_trie_collocations",
    r"""
    with piece as (
        select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as w
        from (
            select coalesce(lang, 'und') as lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        )
    ),
    gram as (
        select lang, k, w[i : i + k - 1] as g
        from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from piece, (select unnest([1, 2, 3, 4]) as k))
    ),
    f as (select lang, k, g, count(*) as f from gram group by lang, k, g),
    n as (select lang, sum(f) as n from f where k = 1 group by lang),
    cand as (select * from f where k > 1 and f >= 30),
    cut as (
        select c.lang, c.g, c.k, c.f as a, c.j, x.f as l, y.f as r, (2000000 :: hugeint * c.f) // (x.f + y.f) as score
        from (select *, unnest(generate_series(1, k - 1)) as j from cand) c
        join f x on x.lang = c.lang and x.g = c.g[1 : c.j]
        join f y on y.lang = c.lang and y.g = c.g[c.j + 1 : c.k]
    ),
    lowest as (select * from cut qualify row_number() over (partition by lang, g order by score, j) = 1),
    inside as (
        select lang, g[i : i + m - 1] as g, max(f) as longer
        from (select lang, g, f, k, m, unnest(generate_series(1, k - m + 1)) as i from (select *, unnest(generate_series(2, k - 1)) as m from cand where k > 2))
        group by 1, 2
    ),
    kept as (
        select lowest.*, array_to_string(lowest.g, ' ') as phrase
        from lowest left join inside on inside.lang = lowest.lang and inside.g = lowest.g
        where longer is null or 100 * longer < 80 * a
    ),
    ranked as (
        select *, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as integer) as rank from kept
    )
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
    from ranked join n using (lang) where rank <= 2000
    """,
)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
