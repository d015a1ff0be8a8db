"""The corpus operators' registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, langid, mixing, secrets, simhash, topk, toxicity, urlfilter, warc
from .common import crc_of_id, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.default_rules()).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, windows, kind: every document and benchmark item with a common passage."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True)
    return found.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.min("kind").alias("kind"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives."""
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least=0).drop("target_uri")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best partners of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    digest = F.sha2(secrets.listing(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest.alias("base_sha256"), secrets.listing(F.col("secret_spans")).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text: the rendered text of every page."""
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.col("rendered").alias("text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_decontaminate, op3_simhash, op4_warc, op5_topk, op6_secrets, op7_language, op8_mixing, op9_html, op10_toxicity)}


# ---------------------------------------------------------------- SQL


def _url_sql() -> str:
    rules = urlfilter.default_rules()
    host, path = "h", "p"
    fits = lambda r: f"(({host} = '{r.text.partition('/')[0]}' or ends_with({host}, '.{r.text.partition('/')[0]}')) and starts_with({path}, '/{r.text.partition('/')[2]}'))"
    own = sorted((r for r in rules if r.host), key=lambda r: -len(r.text))
    rule = "case " + " ".join(f"when {fits(r)} then '{r.text}'" for r in own) + " end"
    by_rule = "case " + " ".join(f"when {fits(r)} then '{r.verdict}'" for r in own) + " end"
    any_of = lambda v: " or ".join(f"regexp_matches(low, '{r.regex.replace(chr(39), chr(39) * 2)}', 's')" for r in rules if not r.host and r.verdict == v)
    return f"""
        with u as (select page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
                          case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        a as (select *, regexp_extract(rest, '^[^/?#]*') as raw from u),
        b as (select *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as p from a)
        select page_id, coalesce(h, '') as host, coalesce(p, '') as path, {rule} as rule,
               coalesce({by_rule}, case when {any_of('allow')} then 'allow' when {any_of('block')} then 'block' else 'allow' end) as verdict
        from b"""


_TOPK_SQL = """
    with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
               where vec_id is not null and embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can express a query; the others are held against brute force in tests."""
    return {"op1_url_filter": _url_sql(), "op5_topk": _TOPK_SQL}
