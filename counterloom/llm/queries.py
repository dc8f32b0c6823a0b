"""The operators over their whole tables, as named queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, decontaminate, multiprobe, packing, part_codes, quality_model, quality_rules, ranked_search, suffix_dedup, surrogates, url_filter, warc_store, word_graph
from .store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SURROGATE_KEY = "a key of the corpus"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced, and how many mentions were."""
    docs = surrogates.replace_personal_data(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return docs.select("doc_id", "text", F.col("_replaced").alias("n_replaced"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier documents."""
    return suffix_dedup.remove_repeated_substrings(_table(spark, sf_dir, "documents")).drop("kept")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window for each."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str = "doc_id") -> Column:
    """One row in five, by the checksum of its id; no label of these is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of the held-out fifth are not used."""
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    scores = quality_model.quality_scores(_table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies, first copy and number of links of every document."""
    return chosen_path.similar_documents(_table(spark, sf_dir, "documents"))


def op7_word_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 20-word windows that start earlier."""
    return word_graph.remove_repeated_spans(_table(spark, sf_dir, "documents")).drop("kept")


URL_RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url. A page's path holds the number of the document it shows; where that is labelled, the url is
    one to block if the document is of low quality or toxic."""
    pages = _table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    named = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labelled = named.join(_table(spark, sf_dir, "labels").select("doc_id", bad.alias("label")), "doc_id")
    return url_filter.judge(pages, URL_RULES, labelled)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document and whether it is kept."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to an archive and describe the records read back."""
    path = new_path(spark, "warc")
    warc_store.write_archive(_table(spark, sf_dir, "pages"), path)
    records = warc_store.read_archive(spark, path)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    rows = _table(spark, sf_dir, "embeddings")
    return multiprobe.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector over 16 codebooks of 64 entries, and how far it is from what the code stands for."""
    return part_codes.encode(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of the highest score for every benchmark item."""
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_quality_model": op4_quality_model,
    "op5_packing": op5_packing,
    "op6_similarity_join": op6_similarity_join,
    "op7_word_graph": op7_word_graph,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc_store": op10_warc_store,
    "op11_multiprobe": op11_multiprobe,
    "op12_part_codes": op12_part_codes,
    "op13_ranked_search": op13_ranked_search,
}


def _part_codes_sql() -> str:
    """Each round as joins of parts and entries; a position's entries are rows (position, entry, components)."""
    near = """select v.rid, v.p, first(c.e order by d, c.e) as e, min(d) as d from parts v join {book} c using (p),
        lateral (select list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as d) group by v.rid, v.p"""
    moved = """select c.p, c.e, case when n is null then c.x else m.x end as x from {book} c left join (
        select p, e, max(n) as n, list(floor(s / n) order by i) as x from (select v.p, a.e, g.i, sum(v.x[g.i]) as s, count(*) as n
        from parts v join {near} a using (rid, p), lateral (select unnest(range(1, len(v.x) + 1)) as i) g group by v.p, a.e, g.i) group by p, e) m on c.p = m.p and c.e = m.e"""
    return f"""
        with kept as (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as rid, list_transform(embedding, lambda v: floor(256 * cast(v as double))) as v from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda v: coalesce(isfinite(v), false)))),
        parts as materialized (select rid, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as x from kept, lateral (select unnest(range(16)) as p)),
        c0 as materialized (select p, cast(rid - 1 as bigint) as e, x from parts where rid <= 64),
        n0 as materialized ({near.format(book="c0")}), c1 as materialized ({moved.format(book="c0", near="n0")}),
        n1 as materialized ({near.format(book="c1")}), c2 as materialized ({moved.format(book="c1", near="n1")}),
        n2 as materialized ({near.format(book="c2")}),
        coded as (select rid, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from n2 group by rid),
        digest as (select sha256(string_agg(array_to_string(list_transform(x, lambda v: cast(cast(v as bigint) as varchar)), ','), ',' order by p, e)) as h from c2)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from kept join coded using (rid), digest
    """


def _ranked_sql() -> str:
    term = "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term"
    return f"""
        with words as (select doc_id, {term.format("text")} from documents),
        tf as (select doc_id, term, count(*) as tf from words group by all),
        doc as (select doc_id, sum(tf) as n from tf group by doc_id),
        total as (select count(*) as docs, sum(n) as len from doc),
        w as (select term, cast(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term),
        m as (select doc_id, 50 + (50 * n * docs) // len as m from doc, total),
        asked as (select distinct item_id, {term.format("text")} from benchmark),
        scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from asked join w using (term) join tf using (term) join m using (doc_id) group by all)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0
        qualify rank <= 50
    """

ORACLE: dict[str, str] = {
    "op10_warc_store": """
        with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
        f as (select *, min(page_id) over (partition by html) as first_id from p)
        select page_id, n as payload_bytes, sha256(html) as payload_digest,
            case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
            case when n >= 100 and page_id <> first_id then first_id end as refers_to
        from f
    """,
    "op12_part_codes": _part_codes_sql(),
    "op13_ranked_search": _ranked_sql(),
}
